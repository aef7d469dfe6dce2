"""A bounded cache shared by all keys, decided for a whole log without going through it in one task.

The cache holds the `capacity` keys that were used last. Whether a use finds its key there depends only on how many different keys were used since
the key's last use (its reuse distance), and that is a count over points (use, last use): uses between the two, without those whose own
last use lies between them as well. What a full cache throws out follows from order alone: the last uses that are never found again leave in their order,
one for each use that misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scale import carried, dominance, lagged, numbered, table
from tidemark.operators.sessions import WINDOW_MS, throttle


def reuse_distances(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """rows with use (their place in order, from 0), last_use (the use before of the same key, null at its first) and reuse (different keys used in between, null at its first)."""
    used = table(numbered(rows.withColumn("__key", F.xxhash64(key)), order, "use"), "cache-uses")
    points = table(lagged(used.select("__key", "use"), "__key", "use", "last_use"), "cache-points")
    again = points.where("last_use is not null").select(F.col("use").alias("x"), F.col("last_use").alias("y"))
    found = dominance(again, "inside").select(F.col("x").alias("use"), F.col("y").alias("last_use"), (F.col("x") - F.col("y") - 1 - F.col("inside")).alias("reuse"))
    return used.join(found, "use", "left").drop("__key")


def lru(rows: DataFrame, key: str, order: list[Column], capacity: int) -> DataFrame:
    """rows with use, hit (the key was in the cache), life (its uses since it came in share this number) and evicts (the key that had to go for it, else null).

    Null is a key like any other. A capacity below 1 counts as 1. Equal rows are uses of their own, in any order.
    """
    capacity = max(1, capacity)
    uses = reuse_distances(rows, F.col(key), order)
    uses = table(uses.withColumn("hit", F.coalesce(F.col("reuse") < capacity, F.lit(False))), "cache-hits")
    missed = numbered(uses.where("not hit").select("use"), [F.col("use")], "n").select("use", (F.col("n") - capacity).alias("n")).where("n >= 0")
    found = uses.where("hit").select(F.col("last_use").alias("use"))
    left = numbered(uses.select("use", key).join(found, "use", "left_anti"), [F.col("use")], "n").select("n", F.col(key).alias("evicts"), F.lit(True).alias("full"))
    gone = missed.join(left, "n").select("use", "evicts")
    lives = uses.select("use", F.when(~F.col("hit"), F.col("use")).alias("came"), F.xxhash64(F.col(key)).alias("__key"))
    lives = carried(lives, [F.col("__key"), F.col("use")], "came", "life").select("use", "life")  # a key's first use is a miss, so nothing is carried to another key
    return uses.join(lives, "use").join(gone, "use", "left").drop("last_use")


def observe(events: DataFrame, key: str, order: str = "timestamp_ms", window_ms: int = WINDOW_MS, capacity: int = 256) -> DataFrame:
    """events with emit and repeats as throttle gives them, from a table of at most `capacity` keys: a key that had to go is new when it comes back."""
    by = [F.col(order), *[F.col(c) for c in events.columns if c == "rowid" and c != order]]
    held = lru(events, key, by, capacity).drop("hit", "reuse", "evicts", "use")
    return throttle(held, [key, "life"], order, window_ms).drop("life")
