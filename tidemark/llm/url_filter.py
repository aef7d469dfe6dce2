"""URL filters by a temporal list join.

DataFrame functions only. Dated list entries (a host is added to or removed from a list) become validity intervals. The distinct hosts
of the captures, with their parent domains, meet the list by an equal join, and each host's intervals become its timeline. Captures
meet the timeline of their own host, and the entries that were active at fetch time decide. So neither a top-level
domain nor a host with very many captures comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, join_hot, table


def host(url: Column) -> Column:
    """The lower-cased host of a URL without user, port and trailing dots; empty if there is none."""
    found = F.regexp_extract(ascii_lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(found, "[.]+$", "")


def suffixes(h: Column) -> Column:
    """A host and its parent domains, the host first: a.b.c, b.c, c."""
    parts = F.split(h, "[.]")
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (host, list, valid_from, valid_to) from dated rows (host, list, action, at).

    An entry holds from an 'add' until the next row of its host and list, whatever that says, and then starts anew if that is
    an 'add' as well; valid_to is null while it is open. Of several rows at one time the 'remove' counts last. Rows without host,
    list or time are left out; repeated rows count once.
    """
    rows = entries.select(ascii_lower(F.col("host")).alias("host"), "list", "action", "at").where("host is not null and list is not null and at is not null").distinct()
    rows = rows.groupBy("host", "list", "at").agg(F.max("action").alias("action"))
    rows = rows.withColumn("valid_to", F.lead("at").over(Window.partitionBy("host", "list").orderBy("at")))
    return rows.where("action = 'add'").select("host", "list", F.col("at").alias("valid_from"), "valid_to")


def timelines(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (own, n, spans) for those hosts (own, n) of which an entry is the host itself or a parent: all its intervals, as long as the list says something about one host."""
    keyed = hosts.select("own", "n", F.explode(suffixes(F.col("own"))).alias("host"))
    met = keyed.join(intervals(entries), "host")
    span = F.struct(F.length("host").alias("n"), (F.col("list") == "allow").alias("allow"), "host", "list", "valid_from", "valid_to")
    return met.groupBy("own", "n").agg(F.collect_list(span).alias("spans"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """A row (page_id, url, fetched, host, matched, list, valid_from, verdict) for each capture.

    Of the active entries the one for the longest host wins, 'allow' before 'block' for the same host; verdict is 'block' if a
    'block' entry won, else 'keep'. A capture with null or hostless URL or null time matches nothing and is kept. Repeated captures
    have one row each. Other columns are ignored.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched")).withColumn("own", host(F.col("url")))
    lines = table(timelines(rows.where("own <> ''").groupBy("own").agg(F.count("*").alias("n")), entries), "url-timeline")
    longest = lines.agg(F.max(F.size("spans"))).first()[0] or 0
    active = F.filter("spans", lambda s: (F.col("fetched") >= s["valid_from"]) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"])))
    out = join_hot(rows, lines, ["own"], "n", 64 + 64 * longest, "left").withColumn("won", F.array_max(active))
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(time_col), F.col("own").alias("host"), F.col("won.host").alias("matched"), F.col("won.list").alias("list"), F.col("won.valid_from").alias("valid_from"),
        F.when(F.col("won.list") == "block", F.lit("block")).otherwise(F.lit("keep")).alias("verdict"),
    )
