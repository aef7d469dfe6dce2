"""Quality rules by distribution divergence.

DataFrame functions only. A document's histograms of character classes and of its language's commonest words are compared with
those of its language by Jensen-Shannon distance. A language's reference is the sum over all its documents that pass the base rule, so
repetitive and tiny junk has no part in it; there is one row for each listed language and one for the rest, so what the driver reads has a
fixed size. Texts are counted once: their counts go to a table, from which references and verdicts come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, bind, table, without, words

#: Common function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "are", "with", "as", "be"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
SYMBOLS = "[#*$%&|<>]"
#: Character classes besides white space, symbols and the rest.
CLASSES = {"upper": "\\p{Lu}", "digit": "\\p{Nd}", "mark": "[.,;:!?'\"()\\-]"}
#: Words below which the base rule fails.
MIN_WORDS = 50
#: Guards of the two distances: fewer code points or words say too little about a distribution, and a document isn't rejected for them.
MIN_CHARS, MIN_COMMON = 300, 70
#: Distances above which a document is rejected.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.26


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def base_features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup_lines = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def repeat_words(w: Column) -> Column:
    """How many words stand in a 3-word window that the list holds twice or more."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def places(g: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))
            few = lambda d: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(d, F.get(g, i)))
            pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            many = bind(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])), lambda x: x["i"])))
            return bind(twice, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= 32, few(d)).otherwise(many))

        return bind(F.sort_array(g), of)

    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    found = bind(bind(grams, places), covered)
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(found)


def histograms(text: Column, lang: Column) -> Column:
    """Struct of two count arrays: character classes, and the language's common words with all other words last."""
    text = F.coalesce(text, F.lit(""))
    space = _count(text, f"[{SPACE}]")
    parts = [*[_count(text, p) for p in CLASSES.values()], _count(text, SYMBOLS), space]
    chars = bind(F.array(*parts), lambda a: F.concat(a, F.array(F.length(text) - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))
    every = sorted({x for v in COMMON_WORDS.values() for x in v})
    lists = F.lit(None).cast("array<string>")
    for k, v in COMMON_WORDS.items():
        lists = F.when(lang == k, F.array(*[F.lit(x) for x in v])).otherwise(lists)

    def tally(w: Column) -> Column:
        common = F.filter(w, lambda x: x.isin(every))
        counts = bind(common, lambda c: F.transform(lists, lambda x: F.size(F.filter(c, lambda y: y == x)).cast("long")))
        return bind(counts, lambda c: F.concat(c, F.array(F.size(w).cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y))))

    return F.struct(chars.alias("chars"), bind(words(text), tally).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null if one is null or sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        terms = F.zip_with(s["p"], s["q"], lambda x, y: part(x / s["n"], (x / s["n"] + y / s["m"]) / 2) + part(y / s["m"], (x / s["n"] + y / s["m"]) / 2))
        return F.when((s["n"] > 0) & (s["m"] > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))

    return bind(F.struct(p.alias("p"), q.alias("q"), total(p.cast("array<double>")).alias("n"), total(q.cast("array<double>")).alias("m")), of)


def language(lang: Column) -> Column:
    """A listed language, or the empty string for all other values."""
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(F.lit(""))


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with a struct column __q of what is counted in each text: language, code points, base features, base_failed and histograms."""
    lang = language(F.col(lang_col))

    def of(s: Column) -> Column:
        b, h = s["b"], s["h"]
        failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
        base = [b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(s["l"].alias("lang"), s["n"].alias("n_chars"), *base, failed.alias("base_failed"), h["chars"].alias("chars"), h["common"].alias("common"))

    parts = F.struct(lang.alias("l"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), base_features(F.col(text_col)).alias("b"), histograms(F.col(text_col), lang).alias("h"))
    return docs.select("*", bind(parts, of).alias("__q"))


def references(rows: DataFrame) -> list:
    """Summed histograms of counted() rows that pass the base rule: a row (lang, chars, common) for each listed language, and lang '' for all other values.

    Sums take nulls for the other rows; a filter would be pushed below the counting and count every text twice.
    """
    n, m = len(CLASSES) + 3, max(map(len, COMMON_WORDS.values())) + 1
    used = bind(F.col("__q"), lambda q: F.struct(q["lang"].alias("lang"), F.when(~q["base_failed"], q["chars"]).alias("chars"), F.when(~q["base_failed"], q["common"]).alias("common")))
    q = rows.select(used.alias("q")).select("q.*")
    sums = q.groupBy("lang").agg(F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(n)]).alias("chars"), F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(m)]).alias("common"), F.count("chars").alias("passed"))
    return [r for r in sums.collect() if r["passed"]]  # a row for each language


def verdict(q: Column, found: list) -> Column:
    """Struct of the base features, both distances, base_failed and kept of a counted() struct; one expression in which the counts stand once."""

    def of(q: Column) -> Column:
        ref = F.lit(None).cast("struct<chars:array<bigint>,common:array<bigint>>")
        for r in found:
            common = F.array(*[F.lit(x).cast("long") for x in r["common"]]) if r["lang"] else F.lit(None).cast("array<bigint>")
            ref = F.when(q["lang"] == r["lang"], F.struct(F.array(*[F.lit(x).cast("long") for x in r["chars"]]).alias("chars"), common.alias("common"))).otherwise(ref)
        far = bind(ref, lambda x: F.struct(distance(q["chars"], x["chars"]).alias("class_distance"), distance(q["common"], x["common"]).alias("word_distance")))
        base = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]

        def judged(d: Column) -> Column:
            strange = ((q["n_chars"] >= MIN_CHARS) & (F.coalesce(d["class_distance"], F.lit(0.0)) > MAX_CLASS_DISTANCE)) | ((q["n_words"] >= MIN_COMMON) & (F.coalesce(d["word_distance"], F.lit(0.0)) > MAX_WORD_DISTANCE))
            return F.struct(*base, d["class_distance"].alias("class_distance"), d["word_distance"].alias("word_distance"), q["base_failed"].alias("base_failed"), (~q["base_failed"] & ~strange).alias("kept"))

        return bind(far, judged)

    return bind(q, of)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, the base counts, class_distance, word_distance, base_failed, kept.

    Null, empty and blank texts have no words and fail the base rule. Languages that aren't listed, null among them, share one
    reference of character classes and have no word distance. A language of which no document passes the base rule has no reference, and
    its distances are null. A distance that is null or guarded rejects nothing. Repeated rows count one by one. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = table(counted(docs).select("id", "__q"), "quality-counts")
    return rows.select(F.col("id").alias(id_col), verdict(F.col("__q"), references(rows)).alias("quality")).select(id_col, "quality.*")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, columns as they are.

    Texts are counted once, into a table of counts. A verdict depends on text and language alone, so what is rejected is known by two hashes of both.
    """
    text, lang = F.coalesce(F.col(text_col), F.lit("")), language(F.col(lang_col))
    on = {"h1": F.xxhash64(text, lang), "h2": F.xxhash64(lang, text)}
    rows = docs.select(text.alias("text"), F.col(lang_col).alias("lang"), *[c.alias(k) for k, c in on.items()])
    rows = table(counted(rows).select("h1", "h2", "__q"), "quality-counts")
    judged = rows.select("h1", "h2", verdict(F.col("__q"), references(rows))["kept"].alias("kept"))
    gone = table(judged.where("not kept").select("h1", "h2").distinct(), "quality-rejected")
    return without(docs, gone, on)
