"""Prefix trie, nearest neighbours and filter audit against brute force, on the paths that size decides and on awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cross_polytope as cp
from tidemark.llm import prefix_trie as pt
from tidemark.llm.filter_audit import audited_documents, filter_audit


@pytest.fixture
def many_partitions(spark):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def trie(rows):
    """conv_id -> turns as the contract has them, then every node by its own definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [total[c] for c in children[p]]
        total[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), *total[p], sha(p)) for p in members)


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed=3):
    """Conversations of few different turns, so that they share many prefixes; one of 400 turns, many equal ones, negative ids, ties, nulls, repeated rows."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.choice([1, 5])) for c in [*range(-40, 60), *range(100, 230), 500, 517] for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(7)]
    rows += [(201, t, "user", f"long {t % 7}") for t in range(10, 410)]
    rows += [(230, None, None, "first"), (230, 1, "user", None), (230, 1, "user", "tie"), (230, 1, "bot", "tie"), (231, 1, "user", "twice"), (231, 1, "user", "twice"), (None, 1, "user", "nobody"), (300, None, "user", "été")]
    return rows


@pytest.mark.parametrize("fan, run", [(64, 2048), (3, 2)])
def test_trie(spark, monkeypatch, many_partitions, fan, run):
    monkeypatch.setattr(pt, "FAN", fan)
    monkeypatch.setattr(pt, "RUN", run)
    rows = talks()
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "at", "n", "part", "open", "h1", "up", "last")})
    assert found(pt.conversation_trie(d)) == trie(rows)


def test_trie_of_little(spark):
    for rows in ([], [(7, None, None, None)], [(None, 1, "user", "x")], [(3, 1, "a", "b"), (3, 2, "a", "b")]):
        assert found(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == trie(rows)


def test_running_values_cross_partitions(spark, many_partitions):
    d = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), "id", (F.col("id") * 7919 % 1000).alias("v"))
    got = pt.running(d, "k", [F.col("id")], ["k", "id", "v"], "test", sums=["v"], xors=["id"]).collect()
    assert len(got) == 5000 and len({r["part"] for r in got if r["k"] == -1}) > 5
    total = bits = 0
    for r in sorted((r for r in got if r["k"] == -1), key=lambda r: r["id"]):
        total, bits = total + r["v"], bits ^ r["id"]
        assert (r["run_v"], r["run_id"]) == (total, bits)


def brute(rows, k, is_query):
    """Each query row's true nearest by the contract."""
    width = {}
    good = []
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, tuple(v)))
            width[len(v)] = width.get(len(v), 0) + 1
    most = max(width, key=lambda w: (width[w], w), default=0)
    good = sorted({g for g in good if len(g[1]) == most})
    out = {}
    for i, v in good:
        if is_query(i):
            s = [(-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if (j, w) != (i, v)]
            out[i] = [(j, -x) for x, j in sorted(s)[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_neighbours_of_awkward_rows_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.2, 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[20], rows[20]]  # copies of one vector, queries among them; a repeated row
    rows += [(301, None), (302, []), (303, [0.0] * 8), (304, [1.0] * 7 + [None]), (305, [1.0] * 7 + [float("nan")]), (306, [1.0] * 7 + [float("inf")]), (307, [1.0] * 5), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "t", "bucket", "query", "label")})
    got, want = answers(cp.nearest(d, F.col("vec_id") % 20 == 0)), brute(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and len(got) == 18
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12, rtol=0)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert answers(cp.nearest(few, F.col("vec_id") % 20 == 0)) == {0: [(3, 3.0), (20, 0.0)], 20: [(3, 2.0), (0, 0.0)]}
    assert answers(cp.nearest(few.limit(0), F.col("vec_id") % 20 == 0)) == {} and answers(cp.nearest(few, F.lit(False))) == {}


@pytest.mark.parametrize("rows, tile, spread", [(64, 4096, 0), (16, 50, 0), (8, 4096, 1)])
def test_neighbours_recall(spark, monkeypatch, rows, tile, spread):
    """Random vectors and a large group of near copies, in buckets of several sizes (codes of one and two axes), small tiles, and vectors of unequal length."""
    monkeypatch.setattr(cp, "ROWS", rows)
    monkeypatch.setattr(cp, "TILE", tile)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[::3] = x[0] + 0.05 * rng.normal(size=(1000, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * 0.3 * rng.normal(size=(3000, 1)))
    data = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got, want = answers(cp.nearest(d, F.col("vec_id") % 20 == 0)), {}
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want[q] = set(np.argsort(-s)[:20])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & want[q]) / 20 for q in want]) >= 0.9
    assert all(abs(s - x[q] @ x[i]) < 1e-12 for q, v in got.items() for i, s in v)
    assert cp.Index(16, 1.0, True, 3000).buckets > 1


def test_pseudo_rotations_keep_products():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = cp.rotated(x, 3)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(y, cp.rotated(x, 4))
    shape = cp.Index(64, 1.0, True, 512 * 128 * 40)
    assert len(shape.axes) == 2 and shape.codes(x, 0).max() < shape.buckets
    near = shape.probes(x, 0, 50)
    assert (near[:, 0] == shape.codes(x, 0)).all() and all(len(set(r)) == 50 for r in near)


def test_audit_of_awkward_documents(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (3, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit(audited_documents(docs, labels), list("ABCDE"), "source", ["good", "toxic"])
    rows, good, toxic = docs.select("doc_id", "source", "text").collect(), {1, 3}, {1}
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    fails = []
    for r in rows:
        t = r["text"] or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in t for c in "#$%&*|"), "E": r["doc_id"] is not None and t in first and r["doc_id"] > first[t]}
        fails.append((r["source"] or "", {k for k, v in f.items() if v}, r["doc_id"] in good, r["doc_id"] in toxic))
    want = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                want[part, "".join(order), k] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, o, k), v in want.items():
            if p == part:
                v.append(removed[o[k - 1]])
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == want and len(want) == 4 * 600
    assert filter_audit(audited_documents(nothing, labels), list("ABCDE"), "source", ["good", "toxic"]).count() == 0


def test_audit_of_given_orders(spark):
    rows = spark.createDataFrame([("a", True, False), ("a", True, True), ("a", None, None), ("b", False, True)], "part string, long boolean, odd boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit(rows, ["long", "odd"], "part", [], orders=[["odd"], ["odd", "long"]]).collect()}
    assert got == {("a", "odd", 1): (2, 1, 1), ("a", "oddlong", 1): (2, 1, 1), ("a", "oddlong", 2): (1, 1, 3), ("b", "odd", 1): (0, 1, 2), ("b", "oddlong", 1): (0, 1, 2), ("b", "oddlong", 2): (0, 0, 0)}
    with pytest.raises(ValueError, match="orders"):
        filter_audit(rows.select("part", *[F.lit(True).alias(f"f{i}") for i in range(7)]), [f"f{i}" for i in range(7)], "part", [])
