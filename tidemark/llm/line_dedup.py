"""Line dedup: lines that many documents hold are kept in one document only.

DataFrame functions only. Lines are exploded under two independent 64-bit hashes of their key, made distinct by document and
counted for each hash (combined before the shuffle, so a line that every document holds shuffles one row a task), hashes over
the threshold meet the exploded lines again, and each document is put together from the positions that stay. Frequent
hashes are broadcast if they are few, and the hot ones among them if not, so no task gets all rows of a line that all documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, bind, join_hot, table

STRIPPED = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The key of every line: ASCII white space stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, kept_text, n_lines, n_dropped) for each row of docs.

    A line whose key has min_chars code points or more and is found in min_docs documents or more goes, except from the
    largest doc_id that holds it. Null and empty texts have one empty line. Rows of one doc_id are one document, whatever their
    number and texts, and have one row each. All rows without doc_id count as one document that is never the largest, so a line
    that only they hold goes nowhere. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = docs.select("doc", F.explode(F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.length(k) >= min_chars))).alias("k"))
    hashed = long.select("doc", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), F.col("k")).alias("g"))
    common = hashed.distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc").alias("keep")).where(F.col("n") >= min_docs)
    common = table(common, "line-common")
    gone = join_hot(hashed, common, ["h", "g"], "n", 40).where("not doc <=> keep").groupBy("doc").agg(F.collect_set("h").alias("gone"))
    left = docs.alias("d").join(gone.alias("g"), F.col("d.doc").eqNullSafe(F.col("g.doc")), "left").select("d.doc", "d.text", "gone")
    lines = F.split("text", "\n", -1)
    hashes = F.transform(line_keys(F.col("text")), lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k)))
    stay = bind(F.struct(lines.alias("line"), hashes.alias("h")), lambda s: F.filter(s["line"], lambda _, i: ~F.coalesce(F.array_contains("gone", F.get(s["h"], i)), F.lit(False))))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(stay)
    out = left.select(F.col("doc").alias(id_col), kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"))
    return out.select(id_col, F.array_join("kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
