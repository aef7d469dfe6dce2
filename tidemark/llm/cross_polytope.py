"""Approximate nearest neighbours by cross-polytope hashing.

Tables of pseudo-rotations (signs and fast Hadamard transforms) assign every vector to its nearest signed axis; a code is one axis or several
rotations' axes in a row, so that a bucket holds about ROWS vectors whatever the table's size. A query probes, in each table, the buckets whose
axes it points to most. How many is fitted on a bounded sample of queries that are compared with every row. Buckets and the queries that
probe them meet in tiles of at most TILE by TILE; every candidate is scored exactly on the original vectors, and a query's best of all tiles are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bind, ceil_div, mix, small, table

#: Hash tables, vectors in a bucket on average, and vectors or queries in a tile at most.
TABLES, ROWS, TILE = 4, 512, 4096
#: Sampled queries to fit the number of probes on, and the recall asked of these probes there.
SAMPLE, RECALL = 128, 0.95
#: Relative spread of lengths up to which vectors count as one length.
EVEN = 1e-4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose width is a power of two, to unit scale."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """Pseudo-rotation number `which` of the rows: three times random signs and a Hadamard transform."""
    for k in range(3):
        bits = mix(np.arange(x.shape[1], dtype=np.uint64) + np.uint64(1 + (3 * which + k) * 4096), seed=12)
        x = hadamard(x * np.where(bits >> np.uint64(63), 1.0, -1.0))
    return x


class Index:
    """What every task has to know: dimensions, the longest length, and the axes of each code. It is a few numbers."""

    def __init__(self, dim: int, longest: float, even: bool, n: int):
        self.dim, self.longest, self.even = dim, longest, even
        self.wide = 1 << max(0, (dim - 1 if even else dim).bit_length())
        buckets, self.axes = max(1, n // ROWS), []
        while buckets > 1:  # each rotation tells up to 2 * wide signed axes apart, the last fewer
            m = min(self.wide, 1 << max(0, (buckets // 2).bit_length() - 1))
            self.axes.append(m)
            buckets //= 2 * m
        self.buckets = int(np.prod([2 * m for m in self.axes])) if self.axes else 1

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows as unit vectors whose inner product orders as the original one: stored vectors are lengthened to one length by a coordinate that queries don't have."""
        long = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.wide))
        out[:, : self.dim] = x / (long if query or self.even else self.longest)
        if not query and not self.even:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (long[:, 0] / self.longest) ** 2))
        return out

    def axes_of(self, placed: np.ndarray, t: int):
        for k, m in enumerate(self.axes):
            y = rotated(placed, t * 16 + k)[:, :m]
            yield m, np.concatenate([y, -y], 1)

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each stored vector in table t."""
        code = np.zeros(len(x), np.int64)
        for m, y in self.axes_of(self.placed(x, False), t):
            code = code * (2 * m) + y.argmax(1)
        return code

    def probes(self, x: np.ndarray, t: int, n: int) -> np.ndarray:
        """The n buckets of table t (all, if fewer) that each query points to most, best first: sums of its coordinates along their axes."""
        if len(x) > 256:  # bounds the arrays of sums
            return np.concatenate([self.probes(x[i : i + 256], t, n) for i in range(0, len(x), 256)])
        code, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for m, y in self.axes_of(self.placed(x, True), t):
            score = (score[:, :, None] + y[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * m) + np.arange(2 * m)).reshape(len(x), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
        return code


def matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row of q) ids and exact scores of its k best rows of x, ties to the smaller id. A score is summed in one order wherever it is computed."""
    found = []
    if len(x) > k:
        rough = q @ x.T
        edge = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        near = rough >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]
    for i in range(len(q)):
        at = np.flatnonzero(near[i]) if len(x) > k else np.arange(len(x))
        score = (q[i] * x[at]).sum(1)
        order = np.lexsort((ids[at], -score))[:k]
        found.append((ids[at][order], score[order]))
    return found


BEST = "best array<struct<far:double,vec_id:bigint>>"


def _lists(keys: list, found: list) -> pa.RecordBatch:
    """Rows (query, best), best being (minus score, id) in ascending order."""
    sizes = np.cumsum([0, *[len(a) for a, _ in found]])
    ids, far = (np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in (0, 1))
    each = pa.StructArray.from_arrays([pa.array(-far.astype(np.float64)), pa.array(ids.astype(np.int64))], names=["far", "vec_id"])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], names=["query", "best"])


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """(query, best): the k best of a query's lists, an id once."""
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    return lists.groupBy("query").agg(F.slice(bind(F.array_sort(F.flatten(F.collect_list("best"))), once), 1, k).alias("best"))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: with an id, no null or non-finite component, not zero, and as many components as most vectors have (on a tie: more). Repeated rows count once."""
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(whole)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"))
    most = widths.agg(F.max_by("w", F.struct("n", "w"))).first()[0]
    return rows.where(F.size("v") == (most or 0)).distinct()


def _tiled(index: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with tile numbers a (of vectors) and b (of queries): a bucket of more than TILE of either is dealt out over several tiles, and the other side goes to each of them."""
    by = ["t", "bucket"]
    pieces = lambda df, c: small(df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > TILE).select(*by, F.ceil(F.col("n") / TILE).cast("int").alias(c)), 24)
    many = [(pieces(index, "m"), "m"), (pieces(probes, "o"), "o")]

    def of(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        for found, _ in many:
            df = df.join(found, by, "left")
        place = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        return df.withColumn(mine, place).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("m", "o")

    return of(index, "m", "o", "a", "b"), of(probes, "o", "m", "b", "a")


def search(index: DataFrame, queries: DataFrame, shape: Index, n_probes: int, k: int) -> DataFrame:
    """(query, best) of queries (id, v) over all of index (t, bucket, id, v)."""

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                x, ids, v = matrix(batch.column(1)), batch.column(0), batch.column(1)
                for t in range(TABLES if shape.axes else 1):
                    found = shape.probes(x, t, n_probes)
                    for j in range(found.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(found[:, j].copy()), ids, v], names=["t", "bucket", "id", "v"])

    kind = queries.schema["v"].dataType.simpleString()
    probes = queries.select("id", "v").mapInArrow(probe, f"t int, bucket long, id long, v {kind}")
    left, right = _tiled(index, probes)

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return _as_table([], [])
        found = best_of(matrix(asked["v"]), matrix(vectors["v"]), vectors["id"].to_numpy(), k)
        return _as_table(asked["id"].to_pylist(), found)

    by = ["t", "bucket", "a", "b"]
    return _merge(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"query long, {BEST}"), k)


def _as_table(keys: list, found: list) -> pa.Table:
    return pa.Table.from_batches([_lists(keys, found)])


def exhaustive(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """(query, best) of a bounded list of queries (id, vector) over all rows (vec_id, v), which each task scans once."""
    ids, q = [x[0] for x in asked], np.array([x[1] for x in asked], np.float64)

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                yield _lists(ids, best_of(q, matrix(batch.column(1)), batch.column(0).to_numpy(), k))

    return _merge(rows.select("vec_id", "v").mapInArrow(scan, f"query long, {BEST}"), k)


def fitted_probes(rows: DataFrame, queries: DataFrame, shape: Index, k: int) -> int:
    """The fewest probes a table with which SAMPLE queries (all, if fewer; those of the smallest hashes) find a share RECALL of their true nearest among all rows."""
    sample = [(r["id"], r["v"]) for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    true = exhaustive(rows, sample, k).select("query", F.explode("best.vec_id").alias("vec_id")).where("vec_id <> query")
    true = true.join(rows, "vec_id").select("query", "v").collect()  # SAMPLE * k vectors
    at = {i: n for n, (i, _) in enumerate(sample)}
    q, x = np.array([v for _, v in sample], np.float64), np.array([r["v"] for r in true], np.float64)
    of = np.array([at[r["query"]] for r in true])
    place = np.full(len(x), shape.buckets)
    for t in range(TABLES):
        code = shape.codes(x, t)
        for i in range(len(q)):
            order = shape.probes(q[i : i + 1], t, shape.buckets if len(shape.axes) < 2 else 4096)[0]
            mine = np.flatnonzero(of == i)
            hit = order[None, :] == code[mine][:, None]
            place[mine] = np.minimum(place[mine], np.where(hit.any(1), hit.argmax(1), shape.buckets))
    return int(np.sort(place)[min(len(place) - 1, ceil_div(RECALL * len(place), 1) - 1)]) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each query row among all other rows by inner product, approximately: recall is fitted to RECALL on a sample.

    Returns query_id, rank (from 1), vec_id, score, nearest first and ties to the smaller id; score is the inner product of the original vectors in
    double precision. A table of up to 2 * ROWS distinct vectors is one bucket, which makes it exact, and a query that finds fewer than k is
    asked again in all buckets, so it gets all candidates if there are no more. Which rows take part: see valid(). Equal vectors are one class that stands
    for itself by its k + 1 smallest ids, as no more can be among the nearest; equal queries are asked once. An id with several different vectors is several
    rows, and each of them a candidate of the others. Null, empty and zero vectors, an empty table and a table without queries give no rows. Other columns are ignored.
    """
    rows = table(valid(vectors, id_col, vec_col).withColumn("asks", F.coalesce(is_query, F.lit(False))), "ann-rows")
    asks = rows.where("asks").groupBy("v").agg(F.min("vec_id").alias("id"))
    held = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1).select("vec_id", "v")
    held, asks = table(held, "ann-held"), table(asks, "ann-asks")

    long = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    seen = held.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(long).alias("most"), F.min(long).alias("least")).first()
    shape = Index(seen["dim"] or 1, seen["most"] or 1.0, (seen["most"] or 1.0) - (seen["least"] or 1.0) <= EVEN * (seen["most"] or 1.0), seen["n"])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                for t in range(TABLES if shape.axes else 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(shape.codes(x, t)), batch.column(0), batch.column(1)], names=["t", "bucket", "id", "v"])

    kind = held.schema["v"].dataType.simpleString()
    index = table(held.mapInArrow(place, f"t int, bucket long, id long, v {kind}"), "ann-index")
    found = search(index, asks, shape, fitted_probes(held, asks, shape, k + 1) if shape.axes and not asks.isEmpty() else 1, k + 1)
    found = table(found, "ann-found")
    if shape.axes:
        need = min(k + 1, seen["n"])
        short = asks.join(found.where(F.size("best") >= need).select(F.col("query").alias("id")), "id", "left_anti")
        if not short.isEmpty():
            again = table(search(index, table(short, "ann-short"), shape, shape.buckets, k + 1), "ann-again")
            found = found.join(again.select("query"), "query", "left_anti").unionByName(again)
    mine = rows.where("asks").join(asks, "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"), (long * long).alias("own"))
    others = F.slice(F.filter("best", lambda x: (x["vec_id"] != F.col("query_id")) | (F.abs(x["far"] + F.col("own")) > 1e-9 * F.col("own"))), 1, k)
    out = mine.join(found, "query").select("query_id", F.posexplode(others).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
