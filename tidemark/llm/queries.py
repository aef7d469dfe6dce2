"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.common import key_hash
from tidemark.llm.cross_polytope import nearest
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.filter_audit import audited_documents, filter_audit
from tidemark.llm.html_extract import html_extract
from tidemark.llm.license_scan import license_scan
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_plan
from tidemark.llm.ngram_jaccard import ngram_jaccard
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.quality import quality_rules
from tidemark.llm.sharding import shard_plan
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.url_filter import host, suffixes, url_filter

SHARD_BYTES = oracles.SHARD_BYTES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_jaccard(_read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when every byte of a 100-byte string that starts earlier is gone."""
    out = substring_dedup(_read(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document."""
    out = quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a ten-word window of a benchmark item."""
    out = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_extract(_read(spark, sf_dir, "pages"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of each document."""
    return license_scan(_read(spark, sf_dir, "documents"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document a mix of all sources at 5, 2, 1 takes."""
    return mix_plan(_read(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(1704067200 + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of the hosts and parent domains of pages: each is blocked, later let go, and some are allowed."""
    hosts = pages.select(F.explode(suffixes(host(F.col("url")))).alias("host")).distinct().withColumn("k", key_hash(F.col("host"))).where("k % 3 = 0 and contains(host, '.')")
    day = lambda x: F.timestamp_seconds(F.lit(1704067200) + F.pmod(x, F.lit(366)) * 86400)
    first, span = F.shiftright("k", 8), F.pmod(F.shiftright("k", 20), F.lit(200)) + 1
    parts = [("block", "add", F.lit(True), day(first)), ("block", "remove", F.lit(True), day(first + span)), ("allow", "add", F.col("k") % 2 == 0, day(first + 20)), ("allow", "remove", F.col("k") % 2 == 0, day(first + 50))]
    rows = F.array(*[F.when(c, F.struct(F.lit(a).alias("list"), F.lit(b).alias("action"), at.alias("at"))) for a, b, c, at in parts])
    return hosts.select("host", F.explode(F.array_compact(rows)).alias("e")).select("host", "e.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of a dated host list on each page at its fetch time."""
    pages = _read(spark, sf_dir, "pages")
    return url_filter(captures(pages), list_entries(pages)).select("page_id", "url", "host", "matched", "list", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines of 40 characters and more that five documents hold, but for the largest of these."""
    out = line_dedup(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, of 64 MiB of text at most."""
    return shard_plan(_read(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations after each took over the first turns of its base."""
    return conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector among all others."""
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of each of their orders, by source."""
    return filter_audit(audited_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")), list("ABCDE"), "source", ["good", "toxic"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_quality_rules, op4_benchmark_decontamination, op5_html_extraction, op6_license_scans, op7_mixing_sources, op8_url_filters, op9_line_dedup, op10_sharding, op11_conversation_prefix_trie, op12_approximate_nearest_neighbours, op13_filter_interaction_audit]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
