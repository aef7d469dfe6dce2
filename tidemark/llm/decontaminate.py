"""Benchmark decontamination by a positional inverted index.

DataFrame functions only. The index's terms are pairs of neighbouring words, because the rarest single word of many windows is a common
one; a term is known by its 64-bit hash. The postings (document, position) of the terms that the test windows hold are stored once, and
their numbers are the terms' document counts. Every window of ten test words is looked up from its LEAD rarest terms: shifted back by
their offsets, their lists must meet in one start. What is left are nearly matches only, and the documents' own words show whether
the whole window stands there, by its hash.

Proximity matches (slop) have single words as terms: every match holds the window's rarest word, so its postings alone lead to all
matches, and the words around them decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_WORD, ascii_lower, bind, sieved, small, table, without, words

#: Terms of a window whose postings are intersected before a document is looked at.
LEAD = 2


def pairs(w: Column) -> Column:
    """Index terms of a list of words: each word with the next one, hashed. A single word is a term of its own."""
    n = F.size(w)
    one = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))).otherwise(one)


def window_id(win: Column) -> Column:
    """What a window is known by: its words' hash and their number."""
    return F.concat(F.xxhash64(F.array_join(win, " ")).cast("string"), F.lit(":"), F.size(win).cast("string"))


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, wid, win): every window of every item as its words."""
    rows = items.select(F.col(id_col).alias("item"), words(ascii_lower(F.col(text_col)), ALNUM_WORD).alias("w")).where(F.size("w") > 0)
    cut = bind(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.slice(w, i, size)))
    rows = rows.select("item", F.explode(cut).alias("win")).distinct()
    return rows.select("item", window_id(F.col("win")).alias("wid"), "win")


def postings(docs: DataFrame, single: bool, near: bool = False) -> DataFrame:
    """Rows (doc, row, pos, term): the pairs of every document, and its words where items of one word ask for them; near: words only."""
    w = words(ascii_lower(F.col("text")), ALNUM_WORD)
    if near:
        return docs.select("doc", "row", F.posexplode(F.transform(w, lambda x: F.xxhash64(x))).alias("pos", "term"))
    if single:  # a text of one word has that word as its only pair, so nothing comes twice
        placed = lambda terms: F.transform(terms, lambda p, i: F.struct(i.alias("pos"), p.alias("term")))
        every = bind(w, lambda x: F.when(F.size(x) > 1, F.concat(placed(pairs(x)), placed(F.transform(x, lambda y: F.xxhash64(y))))).otherwise(placed(pairs(x))))
        return docs.select("doc", "row", F.explode(every).alias("p")).select("doc", "row", "p.pos", "p.term")
    return docs.select("doc", "row", F.posexplode(bind(w, pairs)).alias("pos", "term"))


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc, row, start, len, item): every place where a window of an item stands in a document.

    With slop 0 the window's words stand consecutively. With a larger slop a place is any word of the window from which every other
    word of it stands within len - 1 + slop words, in any order; start is then the place of that word. Nothing depends on the other documents.
    doc is the id as a string (null: empty), row a hash of the text.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))
    win = table(windows(items, size, item_col, item_text_col), "leak-window")
    full = win.select("wid", "win").distinct()
    near = slop > 0
    single = not near and not full.where(F.size("win") == 1).isEmpty()
    terms = full.select("wid", F.posexplode(F.transform(F.array_distinct("win"), lambda x: F.xxhash64(x)) if near else pairs(F.col("win"))).alias("off", "term"))
    index = table(postings(docs, single, near).join(small(terms.select("term").distinct(), 24), "term"), "leak-posting")
    df = table(index.groupBy("term").agg(F.count("*").alias("n")), "leak-term")
    by = terms.join(df, "term", "left").groupBy("wid").agg(F.count("*").alias("all"), F.count("n").alias("seen"), F.array_sort(F.filter(F.collect_list(F.struct("n", "term", "off")), lambda x: x["n"].isNotNull())).alias("t"))  # size terms at most
    lead = F.slice("t", 1, 1 if near else LEAD)
    rare = by.where("seen = all").select("wid", F.size(lead).alias("need"), F.explode(lead).alias("r")).select("wid", "need", "r.term", "r.off")
    posted = index.join(small(table(rare, "leak-rare"), 64), "term")
    full = full.select("wid", "win", F.size("win").alias("len"))
    if near:
        found = posted.groupBy("doc", "row", "wid").agg(F.collect_set("pos").alias("pos"))
        entry, about = F.struct("pos", "wid", "len", "win"), full
    else:
        found = posted.groupBy("doc", "row", (F.col("pos") - F.col("off")).alias("start"), "wid", "need").agg(F.countDistinct("off").alias("n")).where("n = need and start >= 0")
        entry, about = F.struct("start", "wid", "len"), full.drop("win")
    found = found.join(small(about, 160), "wid")
    found = table(found.groupBy("doc", "row").agg(F.collect_set(entry).alias("at")), "leak-candidate")

    def stands(w, c, p, reach):
        return F.size(F.array_except(c["win"], F.slice(w, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, reach) + reach + 1))) == 0

    def spots(w, c):
        """Places of a window's words with all the others within reach; one is never further than that from the rarest word."""
        reach = c["len"] - 1 + slop
        hopeful = F.filter(c["pos"], lambda r: stands(w, c, r, 2 * reach))
        around = F.flatten(F.transform(hopeful, lambda r: F.sequence(F.greatest(r - reach, F.lit(0)), F.least(r + reach, F.size(w) - 1))))
        return F.filter(F.array_distinct(around), lambda p: F.array_contains(c["win"], F.get(w, p)) & stands(w, c, p, reach))

    def here(w):
        if near:
            placed = lambda c: F.transform(spots(w, c), lambda p: F.struct(p.alias("start"), c["wid"].alias("wid"), c["len"].alias("len")))
            return F.flatten(F.transform("at", placed))
        return F.filter("at", lambda c: window_id(F.slice(w, c["start"] + 1, c["len"])) == c["wid"])

    # Only texts that a sieve of the candidates lets through are shuffled, at every size.
    some = sieved(docs, found, ["doc", "row"]).where("maybe").select("doc", "row", "text")
    held = some.join(found.hint("merge"), ["doc", "row"]).select("doc", "row", bind(words(ascii_lower(F.col("text")), ALNUM_WORD), here).alias("at"))
    places = held.select("doc", "row", F.explode("at").alias("c")).select("doc", "row", "c.start", "c.wid", "c.len").distinct()
    return places.join(small(win.select("wid", "item").distinct(), 64), "wid").select("doc", "row", "start", "len", "item")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = 0) -> DataFrame:
    """A row (doc_id, n_words, n_hit, n_items, item_ids, contaminated) for each row of docs.

    Words are lower-cased runs of letters, digits and everything beyond ASCII; null has none. An item shorter than size words
    is one window; one without words has none. Repeated rows each get their row; rows of one doc_id with other texts are told
    apart by the text's hash. Columns besides the named ones are ignored. With slop the places are those of proximity matches, and n_hit counts
    the words from which all others of a window stand within reach.
    """
    found = table(matches(docs, items, size, slop, id_col, text_col, item_col, item_text_col), "leak-match")
    places = found.select("doc", "row", F.explode(F.expr("array(start)" if slop > 0 else "sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy("doc", "row").agg(F.count("*").alias("n_hit"))
    held = found.select("doc", "row", F.col("item").cast("string").alias("item")).distinct().groupBy("doc", "row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("item_ids"))
    hits = places.join(held, ["doc", "row"])
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")), F.lit(0)).cast("long").alias("n_words"),
    )
    out = rows.join(hits, ["doc", "row"], "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which no window of an item stands, columns as they are. Rows are judged by their own id and text, also where ids are null or repeat."""
    found = table(matches(docs, items, size, 0, id_col, text_col, item_col, item_text_col).select("doc", "row").distinct(), "leak-found")
    return without(docs, found, {"doc": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
