"""Filter interaction audit by a subset-zeta transform.

DataFrame functions only. Rows are counted by part and by the set of filters they fail, as bits of a mask; Spark combines these counts before
the shuffle, so a part of any size is a few rows a task. A part's 2^n counts become the survivors of every subset of filters by n additions
over an array: the survivors of a set are the rows whose failures lie in its complement. What a step of an order removes is the difference
between two neighbouring subsets, and the same transform over labelled rows tells what it costs of each label.
"""

from __future__ import annotations

import functools
import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, bind, join_hot, table

#: Filters beyond which all orders are too many to list; pass orders of your own then.
MOST_ORDERED = 6


def zeta(counts: Column, n: int) -> Column:
    """An array of 2^n counts by mask -> for each mask the sum over all its subsets."""

    def add(bit: int):
        return lambda v: F.transform(v, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(v, i - bit)).otherwise(F.lit(0).cast("long")))

    for b in range(n):
        counts = bind(counts, add(1 << b))
    return counts


def filter_audit(rows: DataFrame, filters: list[str], part: str, labels: list[str], orders: list[str] | list[list[str]] | None = None) -> DataFrame:
    """What each filter removes at each step of each order, by part.

    rows has a boolean column for each of filters (true: the row fails it) and of labels; null counts as false. part is cast to string, null
    is the empty string. orders are sequences of filters, all permutations if None; an order may leave filters out.
    One row for each part, order and step: part, filter_order (the filters' names joined), step (from 1), kept (rows after the step), removed,
    redundant (rows that fail the step's filter and were removed earlier), unique_fails (rows that fail no other filter), <label>_lost (labelled
    rows removed) and shapley (what the filter removes, summed over all n! orders). Repeated rows count one by one, other columns are
    ignored, and a table without rows gives none.
    """
    n = len(filters)
    if orders is None:
        if n > MOST_ORDERED:
            raise ValueError(f"{n} filters have {math.factorial(n)} orders: pass those that are asked for")
        orders = list(itertools.permutations(filters))
    at = {f: i for i, f in enumerate(filters)}
    full = (1 << n) - 1
    mask = sum((F.when(F.col(f"`{f}`"), F.lit(1 << i)).otherwise(F.lit(0)) for f, i in at.items()), F.lit(0))
    sums = [F.count("*").alias("all")] + [F.count_if(F.col(f"`{x}`")).alias(f"l{i}") for i, x in enumerate(labels)]
    counted = rows.groupBy(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(*sums)
    names = ["all", *[f"l{i}" for i in range(len(labels))]]
    parts = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("m"))  # at most 2^n entries
    dense = lambda k: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.coalesce(F.col("m")[i][k], F.lit(0).cast("long")))
    parts = parts.select("part", *[zeta(dense(k), n).alias(k) for k in names])

    def share(f: int) -> Column:
        weight = [0 if s >> f & 1 else math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in range(full + 1)]
        w = F.from_json(F.lit(json.dumps(weight)), "array<bigint>")
        return F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda a, s: a + F.get(w, s) * (F.get("all", F.lit(full).bitwiseXOR(s)) - F.get("all", F.lit(full).bitwiseXOR(s).bitwiseAND(F.lit(full ^ 1 << f)))))

    parts = parts.withColumn("shares", F.array(*[share(f) for f in range(n)]))
    steps = []
    for order in orders:
        left = full
        for k, f in enumerate(order, 1):
            steps.append({"o": "".join(order), "k": k, "f": at[f], "x": left, "y": left & ~(1 << at[f])})
            left = steps[-1]["y"]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,k:int,f:int,x:int,y:int>>")
    out = parts.select("*", F.explode(steps).alias("s"))
    lost = lambda k: F.get(k, F.col("s.x")) - F.get(k, F.col("s.y"))
    bit = F.lit(1).cast("int")
    alone = F.get("all", F.call_function("shiftleft", bit, F.col("s.f"))) - F.get("all", F.lit(0))
    fails = F.get("all", F.lit(full)) - F.get("all", F.lit(full).bitwiseXOR(F.call_function("shiftleft", bit, F.col("s.f"))))
    return out.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), F.get("all", F.col("s.y")).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"), alone.alias("unique_fails"),
        *[lost(f"l{i}").alias(f"{x}_lost") for i, x in enumerate(labels)], F.get("shares", F.col("s.f")).alias("shapley"),
    )


def text_filters(text: Column) -> Column:
    """Struct of A (under 200 words), B (distinct words under half of them), C (capitals over 2 % of the code points), D (a symbol of #$%&*|); null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    symbol = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in "#$%&*|"])
    by_words = lambda w: F.struct((F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")).alias("B"))
    return bind(F.struct(bind(words, by_words).alias("w"), (100 * capitals.cast("long") > 2 * F.length(text)).alias("C"), symbol.alias("D")), lambda s: F.struct(s["w"]["A"].alias("A"), s["w"]["B"].alias("B"), s["C"].alias("C"), s["D"].alias("D")))


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs as (doc_id, source, A, B, C, D, E, good, toxic), their texts read once.

    E: a smaller doc_id has the same text (null: the empty one). Texts meet by SHA-256, and only texts that occur twice are joined back, hot ones
    apart. A row without doc_id is no smaller one and never fails E; rows of one doc_id don't repeat each other. A document is good or toxic if
    any of its rows in labels says so; rows without doc_id have no labels.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), text_filters(F.col("text")).alias("f"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))
    rows = table(rows.select("doc_id", "source", "f.*", "digest"), "audit-rows")
    twice = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = join_hot(rows, twice, ["digest"], "n", 64, "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return rows.select("doc_id", "source", "A", "B", "C", "D", "E").join(flags, "doc_id", "left")
