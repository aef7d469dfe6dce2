"""License scans by an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block is any run of words half as long again as a template, so a statement may wrap anywhere and a long
line is no block. Tokens are ordered by how many documents of the whole corpus hold them, rarest first. A template needs a
share of its tokens in a block; of its rarest tokens, so many that the others alone don't suffice are its prefix, and a block
without any of them can't match. So each place of a prefix token, with the template words around it, is joined on it, held to the length and
position bounds, and the blocks around it are counted out. Templates that differ in a word or two are told apart by their
marks, words that a block has to hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_WORD, ascii_lower, bind, table, words

#: Usual license statements as words, with the label of each and its marks, the words without which it is another one or none.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero"]),
    ("apache", "licensed under the apache license version 2 0", ["apache"]),
    ("apache", "apache license version 2 0", ["apache"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution"]),
    ("bsd", "released under the bsd license", ["bsd"]),
    ("cc-by", "licensed under cc by 4 0", ["by", "cc"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc", "nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc", "nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc", "sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["general"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["fee", "permission"]),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 3", ["lesser"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser"]),
    ("mit", "released under the mit license", ["mit"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission"]),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", ["mozilla"]),
    ("reserved", "all rights reserved", ["reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered"]),
]
#: Phrases whose places are counted, with their labels.
PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]
#: Share of a template's words that a block has to hold, and words of a block for each word of the template.
THRESHOLD, SPREAD = 0.8, 1.5


def phrase_places(w: Column) -> Column:
    """Starts of all phrases in a list of words."""

    def here(i: Column) -> Column:
        some = F.lit(False)
        for phrase, _ in PHRASES:
            one = F.lit(True)
            for k, word in enumerate(phrase):
                one = one & (F.get(w, i + k) == word)
            some = some | one
        return some

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def scan(text: Column, templates) -> Column:
    """Struct of n_words, places and base_labels, and of the template words of the text: tokens, each once, and spots, all of them with their
    places, if the text holds a mark. The lower-cased text is searched word by word for phrases only where a phrase's shape is found."""
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    shape = "|".join(gap.join(p) for p, _ in PHRASES)

    vocabulary = sorted({x for _, t, _ in templates for x in t.split()})
    marked = f"(?:^|{gap})(?:{'|'.join(sorted({m[-1] for _, _, m in templates}))})(?:{gap}|$)"

    def of_words(w: Column, low: Column) -> Column:
        none = F.array().cast("array<int>")
        places = F.when(low.rlike(shape) & (F.size(w) > 0), phrase_places(w)).otherwise(none)

        def of(p: Column) -> Column:
            names = F.array(*[F.when(F.exists(p, lambda i: F.get(w, i) == phrase[0]), F.lit(label)) for phrase, label in PHRASES])
            tokens = F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary)))
            spots = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("token"))), lambda s: s["token"].isin(vocabulary))
            return F.struct(F.size(w).cast("long").alias("n_words"), p.alias("places"), F.array_compact(names).alias("base_labels"), tokens.alias("tokens"), F.when(low.rlike(marked), spots).alias("spots"))

        return bind(places, of)

    return bind(ascii_lower(F.coalesce(text, F.lit(""))), lambda low: bind(words(low, ALNUM_WORD), lambda w: of_words(w, low)))


def needed(text: str, threshold: float) -> int:
    return math.ceil(threshold * len(set(text.split())) - 1e-9)


def block_size(text: str) -> int:
    return math.ceil(SPREAD * len(text.split()))


def scanned(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (doc, row, n_words, places, base_labels, tokens, spots): the texts are read once; places and template words are all that is kept of them. row is a hash of the text."""
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row")
    return table(docs.select(F.col(id_col).alias("doc"), row, scan(F.col(text_col), templates).alias("s")).select("doc", "row", "s.*"), "license-scan")


def template_links(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc, row, pos, label, containment) out of scanned(): a block near pos has |block and template| >= threshold * |template| over sets of words, and all of the template's marks.

    containment is the largest of such a block. Every block that qualifies holds a prefix token, whose place is its row's pos.
    """
    vocabulary = sorted({x for _, t, _ in templates for x in t.split()})
    counted = {r["token"]: r["n"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (counted.get(x, 0), x)))}
    index = []
    for label, text, marks in templates:
        s, need = sorted(set(text.split()), key=rank.get), needed(text, threshold)
        index += [(x, label, s, marks, need, i, block_size(text)) for i, x in enumerate(s[: len(s) - need + 1])]
    prefix, reach = sorted({x[0] for x in index}), max(block_size(t) for _, t, _ in templates)
    index = rows.sparkSession.createDataFrame(index, "token string, label string, template array<string>, marks array<string>, need int, i int, m int")
    order = F.create_map(*[y for x in vocabulary for y in (F.lit(x), F.lit(rank[x]))])

    def around(k: Column) -> Column:
        """The spots that a block with spot k in it may hold; there are 2 * reach at most."""
        s = F.get("spots", k)
        some = F.slice("spots", F.greatest(k - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        return F.struct(s["pos"].alias("pos"), s["token"].alias("token"), F.filter(some, lambda x: F.abs(x["pos"] - s["pos"]) < reach).alias("near"))

    at = F.filter(F.sequence(F.lit(0), F.size("spots") - 1), lambda k: F.get("spots", k)["token"].isin(prefix))
    held = rows.where("size(spots) > 0").select("doc", "row", F.explode(F.transform(at, around)).alias("a")).select("doc", "row", "a.*")
    met = held.join(F.broadcast(index), "token")  # the index has a fixed size
    met = met.withColumn("near", F.filter("near", lambda x: F.abs(x["pos"] - F.col("pos")) < F.col("m")))
    met = met.withColumn("tokens", F.array_distinct(F.transform("near", lambda x: x["token"]))).where(F.size("tokens") >= F.col("need"))
    met = met.withColumn("j", F.size(F.filter("tokens", lambda x: order[x] < order[F.col("token")])))
    met = met.where(1 + F.least(F.size("template") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1) >= F.col("need") - F.least("i", "j"))
    met = met.where((F.size(F.array_intersect("tokens", "template")) >= F.col("need")) & (F.size(F.array_except("marks", "tokens")) == 0))

    def block(start: Column) -> Column:
        own = F.transform(F.filter("near", lambda x: (x["pos"] >= start["pos"]) & (x["pos"] < start["pos"] + F.col("m"))), lambda x: x["token"])
        return bind(own, lambda b: F.when(F.size(F.array_except("marks", b)) == 0, F.size(F.array_intersect("template", b))))

    best = F.array_max(F.transform("near", block))
    return met.withColumn("both", best).where("both >= need").select("doc", "row", "pos", "label", (F.col("both") / F.size("template")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no places and no labels. score is the largest containment of a template in a block,
    1 where a base phrase stands and 0 where nothing is found. A base label stays whatever a template says: an LGPL statement has gpl
    as well. Every row is judged by its own text, also where doc_id is null or comes twice. Other columns are ignored.
    """
    base = scanned(docs, id_col=id_col, text_col=text_col)
    links = template_links(base).groupBy(F.col("doc").alias("of"), F.col("row").alias("its")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = base.join(links, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("its")), "left")
    n = F.size("places").cast("long")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        F.col("doc").alias(id_col), "n_words", n.alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.greatest(F.coalesce("best", F.lit(0.0)), (n > 0).cast("double")).alias("score"),
    )
