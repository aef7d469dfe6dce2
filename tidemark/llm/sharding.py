"""Sharding by extendible hashing.

Documents hash to 60 bits. A directory of hash prefixes grows only where it must: a bucket over the byte limit splits
on one more bit, the others stay. Buckets are summed level by level from one histogram of prefixes, so the
rounds needed depend on how uneven the hash is, not on the number of documents; sums combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_hash, small, table

BITS = 60


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards (depth, prefix, shard_bytes, shard_docs) of rows (h, bytes).

    The shards are the shallowest buckets within the limit. Rows of one hash can't be split, so a bucket that holds a
    single hash is a shard even over the limit: a document larger than the limit, or many rows of one doc_id.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 3)
    leaves = rows
    found = None
    while True:
        leaf = leaves.groupBy(F.shiftright("h", BITS - high).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("least"), F.max("h").alias("most"))
        levels = leaf.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "p", "bytes", "docs", "least", "most")
        at = F.expr(f"shiftright(p, {high} - depth)")
        levels = levels.groupBy("depth", at.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("least").alias("least"), F.max("most").alias("most"))
        levels = table(levels.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most"))), "shard-level")
        over = levels.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fit = levels.where("fits").select("depth", "prefix", "shard_bytes", "shard_docs")
        new = fit.withColumn("parent", F.shiftright("prefix", 1)).join(over, ["depth", "parent"], "left_semi").drop("parent")
        new = new.unionByName(fit.where(F.col("depth") == low))
        found = new if found is None else found.unionByName(new)
        if high == BITS:
            return found
        left = levels.where((F.col("depth") == high) & ~F.col("fits")).select("prefix")
        if left.isEmpty():
            return found
        leaves = table(leaves.join(left, F.shiftright("h", BITS - high) == F.col("prefix"), "left_semi").select("h", "bytes"), "shard-leaf")
        low, high = high + 1, min(BITS, high + 6)


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows (h, ...) with the shard of each: an equal join on the prefix at the directory's least depth, then on the shard's own."""
    shards = table(shards, "shard-directory")
    least = shards.agg(F.min("depth")).first()[0] or 0
    entry = F.expr(f"shiftright(prefix, depth - {least})")
    shards = small(shards.withColumn("entry", entry), 64)
    same = (F.shiftright("h", BITS - least) == F.col("entry")) & (F.expr(f"shiftright(h, {BITS} - depth)") == F.col("prefix"))
    return rows.join(shards, same).drop("entry")


def shard_plan(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs) for each row of docs.

    A null text has 0 bytes; null ids hash as the empty string; rows of one doc_id stay together. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col), key_hash(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    rows = table(rows, "shard-rows")
    return assign(rows, directory(rows, limit)).select(id_col, F.col("bytes").alias("n_bytes"), "depth", "prefix", "shard_bytes", "shard_docs")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """docs with the column shard_col: the shard's prefix bits behind its depth, as in 3-101. A column that docs has by that name, in any case, is replaced."""
    rows = table(docs.select(key_hash(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "shard-rows")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != shard_col.lower()]).alias("row"), key_hash(F.col(id_col)).alias("h"))
    name = F.concat(F.col("depth").cast("string"), F.lit("-"), F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return assign(whole, directory(rows, limit)).select("row.*", name.alias(shard_col))


def write_shards(docs: DataFrame, path: str, limit: int, **names) -> None:
    """One folder of Parquet for each shard; rows of a shard are written by one task."""
    name = names.get("shard_col", "shard")
    shard(docs, limit, **names).repartition(name).write.partitionBy(name).parquet(path)
