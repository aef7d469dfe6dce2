"""Helpers shared by the training-data operators: shared-folder tables, connected components, text expressions."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
#: Words between ASCII white space, and words of letters, digits and everything beyond ASCII.
WORD = f"[^{SPACE}]+"
ALNUM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above this many bytes by its exact row count, a lookup table is joined by shuffle and never broadcast.
BROADCAST_BYTES = 32 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def key_hash(c: Column) -> Column:
    """60 uniform bits of a key, the same in any SQL engine that has md5; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, as in tests, gets one of its own where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. Results read their tables from it, so it is deleted with the application, by whoever owns the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


#: Lets Spark drop the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, and a lost executor costs no more than its tasks.

    The shuffle files of the step go as soon as it is written, so disk is bounded by one step and the tables.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its counted rows times row_bytes are within BROADCAST_BYTES; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Rows of one key from which it is hot.
HOT = 100_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """Inner or left join of left with right, whose column n tells how many rows of left each key has.

    right is broadcast if it is small. Otherwise its hot keys, of which there is one for HOT rows of left at most, are joined
    apart, by a broadcast if they are small, so that no task gets all rows of a hot key; the others are joined by shuffle.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    hot = small(right.where(F.col(n) >= HOT), row_bytes)
    rest = left.join(small(right.where(F.col(n) >= HOT).select(*on), row_bytes), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.where(F.col(n) < HOT), on, how))


#: 64-bit words of a sieve: 4 MiB of bits, a few times that when broadcast, whatever it is filled with.
SIEVE_WORDS = 1 << 19


def sieved(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df with the column maybe, false only where the key `on` isn't among keys; so texts without a partner needn't be shuffled to find that out.

    The keys' hashes set bits of a bitmap of fixed size, which is broadcast. With m keys about m / (64 * SIEVE_WORDS) of the others are true as well.
    """
    h = F.xxhash64(*[F.col(c) for c in on])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright(h, 6), F.lit(SIEVE_WORDS)).alias("__word")
    bits = keys.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    out = df.select("*", word).join(F.broadcast(bits), "__word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def without(df: DataFrame, gone: DataFrame, on: dict[str, Column]) -> DataFrame:
    """The rows of df whose key, given by on as column of gone -> expression over df, isn't in gone; columns as they are. Null keys are in no table.

    Rows outside a sieve of gone stay where they are; only the others are shuffled to be sure. gone is read twice, so it should be a table.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    marked = sieved(df.select(whole, *[c.alias(k) for k, c in on.items()]), gone, list(on))
    inside = marked.where("maybe").join(gone.hint("merge"), list(on), "left_anti")
    return marked.where("not maybe").select("__row.*").unionByName(inside.select("__row.*"))


#: Edges that one task contracts on its own.
CHUNK = 500_000


def contract(batches):
    """Edges (a, b) of one task as stars: (node, smallest node that these edges reach from it)."""
    edges = [np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches if x.num_rows]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node, component its smallest node.

    Tasks of at most about CHUNK edges contract theirs to stars first. Where that takes several tasks, large-star and
    small-star steps alternate until nothing changes. Degrees are met by aggregates and joins, which Spark combines before the
    shuffle and splits where skewed; no adjacency list is ever built.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    tasks = max(1, ceil_div(now.count(), CHUNK))
    now = table(now.coalesce(tasks).mapInArrow(contract, "a long, b long"), f"{name}-edges")
    before = None
    while tasks > 1:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        step = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        step = step.unionByName(low.select("a", F.col("low").alias("b")))
        now = table(step.distinct(), f"{name}-edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def contiguous(batches, key: list[str]):
    """Arrow tables of whole groups out of batches sorted by key; a group that crosses batches is put together again.

    Yields (table, starts): the rows of one or more whole groups and where each group starts.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        first, new = tuple(k[0] for k in keys), tuple(k[-1] for k in keys)
        change[0] = last is not None and first != last
        at = np.flatnonzero(change)
        last = new
        if not len(at):
            rest.append(batch)
            continue
        rest.append(batch.slice(0, at[-1]))
        whole = pa.Table.from_batches([x for x in rest if x.num_rows])
        rest = [batch.slice(at[-1])]
        if whole.num_rows:
            yield whole, _starts(whole, key)
    if rest:
        whole = pa.Table.from_batches(rest)
        yield whole, _starts(whole, key)


def _starts(whole: pa.Table, key: list[str]) -> np.ndarray:
    change = np.zeros(whole.num_rows, bool)
    change[0] = True
    for k in key:
        v = whole.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ceil_div(a: float, b: float) -> int:
    return math.ceil(a / b)
