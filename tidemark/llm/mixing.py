"""Mixing sources to target weights.

DataFrame functions only. Sizes are summed for each source, targets follow from weights by filling up: a source never
gets more than max_rate times its own size, and what it can't take is shared among the others by weight. A document of a
source with rate r is emitted floor(r) times, and once more if the hash of its seed and doc_id, as a fraction, is
below the rest of r. The draw depends on nothing else, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, key_hash, small


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take weights in turn. With caps c and weights w, the level is the
    largest (total - sum of c before i) / (sum of w from i on) over the sources in order of c / w, and a target is
    min(c, w * level): the fixed point of sharing the excess again until no target is above its cap. One row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(max_rate)).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") - before) / rest)
    by = by.withColumn("level", F.max("level").over(Window.partitionBy()))
    return by.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def copies(doc: Column, size: Column, target: Column, seed: str) -> Column:
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    draw = key_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))) / F.lit(float(2**60))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def _planned(docs: DataFrame, seed: str, weights, share: float, max_rate: float, id_col: str, source_col: str, text_col: str, more: list) -> DataFrame:
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, weights, share, max_rate)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *more)
    targets = small(targets.withColumnRenamed("source", "of"), 64)
    out = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("copies", copies(F.col("doc"), F.col("source_size"), F.col("target"), seed))


def mix_plan(docs: DataFrame, seed: str = "mix-1", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_rate: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row (doc_id, size, source_size, target, taken) for each row of docs.

    Size is the number of words, 0 for null, empty and blank texts. Null is a source of its own, the last one. A source
    without words has target 0. Rows with one doc_id are drawn alike; null ids draw as the empty string. Other columns are ignored.
    """
    out = _planned(docs, seed, weights, share, max_rate, id_col, source_col, text_col, [])
    return out.select(F.col("doc").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix-1", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_rate: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the plan takes it, columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _planned(docs, seed, weights, share, max_rate, id_col, source_col, text_col, [whole])
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
