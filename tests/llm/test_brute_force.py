"""The operators that SQL can't express against brute force over whole tables, on every path that size decides; the others against their SQL."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import ngram_jaccard as nj
from tidemark.llm import oracles, queries
from tidemark.llm import substring_dedup as sd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "pages", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(texts: dict, width: int, num: int, den: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, k in met.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(spark):
    """Groups of copies of several sizes, each word exchanged with some probability, around the threshold."""
    import random

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 9, 20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 12, 40])):
            rate = rng.choice([0, 0.005, 0.02, 0.04])
            rows.append((len(rows) + 1, " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width, num, den, tile", [(4, 85, 100, 1024), (5, 80, 100, 4), (3, 50, 100, 7)])
def test_jaccard_near_copies(spark, width, num, den, tile):
    docs = near_copies(spark).cache()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_jaccard(docs, width, num, den, tile=tile).collect()}
    assert got == components({r[0]: r[1] for r in docs.collect()}, width, num, den)


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_components(spark, monkeypatch, chunk):
    import random

    from tidemark.llm import common

    monkeypatch.setattr(common, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(i + 1000, i + 1001) for i in range(60)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want and near[x] != {x} else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "test").collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_jaccard_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_jaccard_join(spark, DATA).collect()}
    assert got == components({r["doc_id"]: r["text"] for r in docs.collect()}, 4, 85, 100)


def test_proximity_matches(spark):
    """Every word within reach, also where no pair of neighbours of the item stands in the document, against brute force."""
    import random

    from tidemark.llm.decontaminate import decontaminate, matches

    rng = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    rows = [(1, "a x b c"), (2, "b c"), (3, "b c and b c"), (4, "a x b x c"), (5, "c x a"), (6, "a " + "x " * 40 + "b c"), (7, None), (8, "a x b c"), (8, "a x b c"), (9, "ONE a")]
    rows += [(10 + i, " ".join(rng.choices(words, k=rng.choice([3, 9, 40])))) for i in range(60)]
    items = [(1, "a b c"), (2, "one"), (3, "nowhere b c"), *[(10 + i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([2, 3, 4, 4, 5, 7])]]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 3):
        want = set()
        for d, t in rows:
            w = (t or "").lower().split()
            for item, text in items:
                all_ = text.split()
                for win in {tuple(all_[k : k + 4]) for k in range(max(len(all_) - 3, 1))}:
                    reach = len(win) - 1 + slop
                    want |= {(str(d), p, len(win), item) for p in range(len(w)) if w[p] in win and set(win) <= set(w[max(p - reach, 0) : p + reach + 1])}
        assert {(r["doc"], r["start"], r["len"], r["item"]) for r in matches(docs, bench, size=4, slop=slop).collect()} == want
        assert {("1", 1), ("4", 1), ("8", 1)} <= {(d, item) for d, _, _, item in want}
    got = decontaminate(docs, bench, size=4, slop=3).collect()
    assert len(got) == len(rows) and {(str(r["doc_id"]), r["n_hit"]) for r in got if r["contaminated"]} == {(d, len({p for x, p, _, _ in want if x == d})) for d in {x[0] for x in want}}


def repeats(rows, length):
    seen, out = set(), {}
    for i, raw in sorted(rows):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket, frequent, piece", [(20_000, 64, sd.PIECE), (1, 64, sd.PIECE), (20_000, 2, sd.PIECE), (20_000, 64, 700)])
def test_substrings_table(spark, monkeypatch, bucket, frequent, piece):
    monkeypatch.setattr(sd, "BUCKET", bucket)
    monkeypatch.setattr(sd, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    if piece == 700:
        import pyarrow as pa

        monkeypatch.setattr(sd, "PIECE", piece)
        texts = [r["text"] for r in docs.select("text").limit(40).collect()]
        data, offsets = sd.utf8(pa.array(texts))
        whole = Counter()
        for row, start, count, *_ in sd.runs(data, offsets, 100, sd.GRAM):
            for r, s, c in zip(row.tolist(), start.tolist(), count.tolist(), strict=True):
                whole[r] += c
                assert s + c - 1 + 100 <= len(texts[r].encode())
        assert all(whole[i] == max(0, len(t.encode()) - 99) for i, t in enumerate(texts))
        return
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_suffix_array_dedup(spark, DATA).collect()}
    assert got == repeats([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], 100)


@pytest.mark.parametrize("length", [30, 100])
def test_substrings_in_one_document(spark, length):
    rows = [(1, "abcdefghijklmnopqrstuvwxyz0123456789" * 12), (2, "z" * 400), (3, "é" * 150 + "abcdefghijklmnopqrstuvwxyz0123456789" * 4), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in sd.substring_dedup(docs, length=length, gram=16).collect()}
    assert got == repeats([(i, (t or "").encode()) for i, t in rows], length)


def test_pages_table(spark):
    from html import unescape

    got = {r["page_id"]: r["text"] for r in queries.op5_html_extraction(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>?", "", p))).strip() for p in re.split(r"</?(?:h1|p)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_minimum_cut_against_all_labellings():
    """The cut's labelling costs as little as the cheapest of all of them, on small random graphs."""
    import random
    from itertools import product

    from tidemark.llm.html_extract import cut

    def cost(scores, ties, labels):
        return sum(s for s, k in zip(scores, labels, strict=True) if s > 0 and not k) - sum(s for s, k in zip(scores, labels, strict=True) if s < 0 and k) + sum(w for a, b, w in ties if labels[a] != labels[b])

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        scores = [rng.choice([rng.uniform(-4, 4), rng.uniform(-0.6, 0.6), 0.0]) for _ in range(n)]
        ties = [(i, i + 1, 0.15) for i in range(n - 1)] + [(*sorted(rng.sample(range(n), 2)), rng.uniform(0, 1)) for _ in range(rng.randint(0, n) if n > 1 else 0)]
        got = cut(scores, ties)
        assert abs(cost(scores, ties, got) - min(cost(scores, ties, k) for k in product([False, True], repeat=n))) < 1e-6


TITLE = "How the river was won"
TEXT = ["The first paragraph tells at some length how the river was dammed, by whom and why it took so many years to finish.", "Short one.", "The last paragraph, again long enough to be taken for what it is, tells what became of the fish and of the people who lived on them."]
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT)
MENU = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Sport", "Contact us")) + "</ul>"
COMMENT = "This reader has a great deal to say about rivers and fish and dams, and says it here at a length that a paragraph of the article has."
LAYOUTS = {
    "plain article": f"<nav>{MENU}</nav><article>{BODY}</article><footer>c</footer>",
    "layout class around everything": f"<div class='site has-sidebar'><div class='menu'>{MENU}</div><div class='entry'>{BODY}</div><div class='sidebar'><p>{COMMENT}</p></div></div>",
    "sidebar class around the page": f"<div class='sidebar-right layout'><div class='entry'>{BODY}</div></div>",
    "form around the page": f"<form id='aspnetForm'><div class='navigation'>{MENU}</div><div id='mainContent'>{BODY}</div></form>",
    "comments with articles": f"<main>{BODY}</main><section class='comments'><article class='comment'><p>{COMMENT}</p></article><article><div class='content'><p>{COMMENT}</p></div></article></section>",
    "comments within the article": f"<article>{BODY}<div id='comments'><div class='content'><p>{COMMENT}</p></div></div></article>",
    "notices and adverts": f"<div class='cookie-notice'><p>{COMMENT}</p></div><div class='ad'>{COMMENT}</div><article>{BODY}<aside><div class='content'><p>{COMMENT}</p></div></aside></article><div class='newsletter'><form><p>{COMMENT}</p></form></div>",
    "no names at all": f"<div>{MENU}</div><div>{BODY}</div>",
    "unclosed elements": f"<svg><object><select><option>x<nav>{MENU}</nav><article>{BODY}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    from tidemark.llm.html_extract import main_blocks

    assert main_blocks(f"<html><body>{LAYOUTS[name]}</body></html>") == [TITLE, *TEXT]


INNER = {
    "headings with anchors": ("<h2 id='share-prices'>Prices</h2><h3 id='login'>In</h3><h3 id='menu' class='comments'>Cards</h3>", ["Prices", "In", "Cards"]),
    "names that say something else": ("<p class='related-work'>Others.</p><p class='legal-history'>Courts.</p>", ["Others.", "Courts."]),
    "sections with anchors": ("<section id='legal'><h2>Law</h2><p>All of it.</p></section>", ["Law", "All of it."]),
    "formulas": ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p>", ["So x=2."]),
    "dialogue": ("<p>Yes.</p><p>No.</p><p>Why?</p><p>Because.</p>", ["Yes.", "No.", "Why?", "Because."]),
    "tables": ("<table>" + "".join(f"<tr><td>a{i}</td><td>{i}</td></tr>" for i in range(20)) + "</table>", [x for i in range(20) for x in (f"a{i}", f"{i}")]),
    "lists": ("<ul>" + "".join(f"<li>item {i}</li>" for i in range(20)) + "</ul>", [f"item {i}" for i in range(20)]),
    "definitions": ("<dl><dt>Dam</dt><dd>A wall.</dd></dl>", ["Dam", "A wall."]),
}


@pytest.mark.parametrize("around", ["<nav>{m}</nav><article>{b}</article><footer>c</footer>", "<div>{m}</div><div>{b}</div><div><a href='/t'>Terms of use</a></div>", "<div id='menu'>{m}</div><div class='entry-content'>{b}</div>"])
@pytest.mark.parametrize("name", INNER)
def test_articles_keep_what_is_in_them(name, around):
    from tidemark.llm.html_extract import main_blocks

    part, want = INNER[name]
    body = f"<h1>{TITLE}</h1><p>{TEXT[0]}</p>{part}<p>{TEXT[2]}</p>"
    assert main_blocks(f"<html><body>{around.format(m=MENU, b=body)}</body></html>") == [TITLE, TEXT[0], *want, TEXT[2]]
    ends = f"<h1>{TITLE}</h1><p>{TEXT[0]}</p>{part}"
    assert main_blocks(f"<html><body>{around.format(m=MENU, b=ends)}</body></html>") == [TITLE, TEXT[0], *want]


def test_little_pages_and_unnamed_comments():
    from tidemark.llm.html_extract import main_blocks

    assert main_blocks("<p>Just a short note.</p>") == ["Just a short note."] and main_blocks(f"<div>{MENU}</div><p>Short.</p>") == ["Short."]
    for heading in ("12 responses", "Leave a reply", "Comments (3)", "No comments"):
        page = f"<body><div>{MENU}</div><div>{BODY}</div><section><h2>{heading}</h2><p>{COMMENT}</p><p>Me too.</p></section></body>"
        assert main_blocks(page) == [TITLE, *TEXT]
    told = f"<article><h1>{TITLE}</h1><p>{TEXT[0]}</p><section><h2>Responses to climate change</h2><p>{TEXT[2]}</p></section></article>"
    assert main_blocks(told)[2:] == ["Responses to climate change", TEXT[2]]
    assert main_blocks(f"<article>{BODY}<div class='ad-slot-2'><p>Buy.</p></div><p class='advert'>Buy.</p><div class='share-buttons'>Share</div><section id='comments'><p>{COMMENT}</p></section></article>") == [TITLE, *TEXT]


def test_hostile_pages_take_linear_time():
    import time

    from tidemark.llm.html_extract import main_blocks

    began = time.perf_counter()
    for part in ("<svg>", "<option>a", "<div>", "<div></p>", "<li><ul>", "<!-", "<a ", "x<br>"):
        main_blocks(part * 60_000)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = queries.queries()[name](spark, DATA).toPandas()
    its = con.execute(oracles.SQL[name]).df()
    key = lambda d: sorted((tuple("-" if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=repr)
    assert sorted(mine.columns) == sorted(its.columns) and key(mine) == key(its)


def test_small_shards_match_sql(spark):
    """The query's limit is larger than a small table; here the directory has to split."""
    from tidemark.llm.sharding import shard_plan

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for limit in (1 << 12, 1 << 16):
        mine = {tuple(r) for r in shard_plan(spark.read.parquet(f"{DATA}/documents.parquet"), limit).select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes", "shard_docs").collect()}
        its = {tuple(r) for r in con.execute(f"select doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs from ({oracles.shards(limit)})").fetchall()}
        assert mine == its and len({r[2:4] for r in mine}) > 4


def contaminated(texts: dict, items: list, size: int) -> set:
    """Documents in which a window of an item stands, by plain search."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for w in map(split, items):
        for k in range(max(len(w) - size, 0) + 1) if w else ():
            windows[len(w[k : k + size])].add(tuple(w[k : k + size]))
    return {i for i, t in texts.items() for w in [split(t)] for n, some in windows.items() if any(tuple(w[k : k + n]) in some for k in range(len(w) - n + 1))}


def mixed(texts: dict, sources: dict) -> dict:
    """How often the mix takes each document: targets by sharing the excess again and again, copies by the hash of the id."""
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in texts.items()}
    names = sorted(set(sources.values()), key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    own = {x: sum(size[i] for i in texts if sources[i] == x) for x in names}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(own.values()), set(names)
    while open_:
        shared = sum(weight[x] for x in open_)
        full = {x for x in open_ if left * weight[x] / shared >= 2 * own[x]}
        if not full:
            target |= {x: left * weight[x] / shared for x in open_}
            break
        for x in full:
            target[x] = 2.0 * own[x]
        left -= sum(target[x] for x in full)
        open_ -= full
    out = {}
    for i in texts:
        rate = target[sources[i]] / own[sources[i]] if own[sources[i]] else 0.0
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:15], 16) / 2**60
        out[i] = int(rate + 1e-12) + (draw < rate - int(rate + 1e-12))
    return out


def test_pipeline(spark):
    """Every stage against brute force over what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = docs.columns
    held = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in held.collect()}
        sources = {r["doc_id"]: r["source"] for r in held.collect()}
        held = stage(spark, held, DATA).cache()
        after = {r["doc_id"]: r["text"] for r in held.collect()}
        assert set(after.items()) <= set(before.items()) and (held.columns == names or i == 4)
        if i == 0:
            assert set(after) == {r["doc_id"] for r in queries.op3_quality_rules(spark, DATA).where("kept").collect()}
        if i == 1:
            assert set(after) == {k for k, (_, c) in components(before, 5, 80, 100).items() if c == k}
        if i == 2:
            assert set(after) == set(before) - contaminated(before, items, 10)
        if i == 3:
            assert {r["doc_id"]: r["count"] for r in held.groupBy("doc_id").count().collect()} == {k: n for k, n in mixed(before, sources).items() if n}
        if i == 4:
            assert held.columns == [*names, "shard"] and held.groupBy("doc_id").agg({"shard": "max"}).count() == len(after)
            assert all(r["n"] <= corpus_pipeline.SHARD_BYTES for r in held.selectExpr("shard", "octet_length(text) as b").groupBy("shard").agg({"b": "sum"}).toDF("shard", "n").collect())
    assert held.count() == corpus_pipeline.run(spark, DATA).count()


def test_linked_sets_keep_a_key_in_common_in_any_order():
    import numpy as np

    rng, bands, plans, met = np.random.default_rng(3), nj.Bands(80, 100), {}, 0
    for trial in range(600):
        n = int(rng.integers(1, 60 if trial % 2 else 900))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        key, of, spared = nj.all_keys([a, b], bands, plans)
        common = np.intersect1d(key[of < 2], key[of >= 2])
        for order in ("common first", "any"):
            hot = common if order == "common first" else np.unique(key)
            kept = ~nj.left_out(key, of, spared, hot, rng.permutation(len(hot)).astype(np.int32))
            assert len(np.intersect1d(key[kept & (of < 2)], key[kept & (of >= 2)]))
        met += 1
    assert met > 200 and max(bands.plan(25)) > 8


def test_a_passage_that_many_documents_quote_ties_no_cluster(spark, monkeypatch):
    """Before, such documents were one cluster, whose tiles all met each other: work and disk grew with the square of their number."""
    import random

    rng, largest, tiled = random.Random(9), [], nj.tiled
    passage = [f"p{i}" for i in range(60)]
    texts = {i: " ".join([f"w{rng.randrange(10**6)}" for _ in range(300)] + passage) for i in range(1, 601)}
    texts |= {i + 1000: t + " more" for i, t in texts.items() if i % 50 == 0}

    def seen(members, tile):
        largest.append(members.groupBy("cluster").count().agg({"count": "max"}).first()[0])
        return tiled(members, tile)

    monkeypatch.setattr(nj, "tiled", seen)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_jaccard(docs).collect()}
    assert got == components(texts, 5, 80, 100) and largest[0] < 20
