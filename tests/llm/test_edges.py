"""Awkward inputs: each operator gives every row its defined result and doesn't mind other columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate, matches, without_contaminated
from tidemark.llm.html_extract import html_extract
from tidemark.llm.license_scan import license_scan
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix, mix_plan
from tidemark.llm.ngram_jaccard import ngram_jaccard
from tidemark.llm.quality import quality_filter, quality_rules
from tidemark.llm.sharding import shard, shard_plan, write_shards
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.url_filter import url_filter

ITEMS = "item_id long, text string"


def by_id(d, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in d.collect()}


def test_ngram_jaccard(docs, nothing):
    got = by_id(ngram_jaccard(docs, width=5, num=80, den=100), "n_shingles", "component_id")
    assert len(got) == 12 and got[1][1] == got[2][1] == got[3][1] == 1 and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (1, 7) and got[None][1] is None and got[None][0] == got[1][0]
    assert ngram_jaccard(nothing).count() == 0


def test_ngram_jaccard_rows_without_id(spark):
    rows = [(None, "same few words in each of these"), (None, None), (1, "one"), (2, "two")]
    d = spark.createDataFrame(rows * 3, "doc_id long, text string").coalesce(1)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # three batches of one size
    try:
        got = sorted(tuple(r) for r in ngram_jaccard(d, width=5).where("doc_id is null").select("n_shingles").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == [(0,)] * 3 + [(3,)] * 3


def test_substring_dedup(docs, nothing):
    unique = docs.dropDuplicates(["doc_id", "text"])
    got = by_id(substring_dedup(unique, length=100), "n_bytes", "n_removed", "n_spans")
    from test_brute_force import repeats

    n = len(docs.where("doc_id = 1").first()["text"])
    want = repeats([(r["doc_id"], (r["text"] or "").encode()) for r in unique.where("doc_id is not null").collect()], 100)
    assert {k: v for k, v in got.items() if k is not None} == {k: v[:3] for k, v in want.items()} and got[None] == (n, 0, 0)
    assert got[1] == (n, 0, 0) and got[2] == (n, n, 1) and got[3] == (n + 6, n, 1) and got[4] == got[5] == (0, 0, 0) and got[11] == (300, 299, 1)
    assert substring_dedup(nothing).count() == 0


def test_substring_dedup_repeated_rows(spark, docs):
    # Rows that repeat as a whole count once: neither takes the other's text away, in one Arrow batch or in two.
    unique = docs.dropDuplicates(["doc_id", "text"])
    want = by_id(substring_dedup(unique, length=100), "n_bytes", "n_removed", "n_spans", "kept")
    got = substring_dedup(docs, length=100)
    assert got.count() == docs.count() and by_id(got, "n_bytes", "n_removed", "n_spans", "kept") == want
    text = "".join(chr(97 + i * i * i % 26) + str(i) for i in range(200))
    rows = [(1, text), (1, text), (2, "own start " + text), (2, "own start " + text), (3, "z" * 50)]
    for parts in (1, 3):
        got = sorted((r["doc_id"], r["n_bytes"] - r["n_removed"], r["kept"].decode()) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), length=100).collect())
        assert got == [(1, len(text), text)] * 2 + [(2, 10, "own start ")] * 2 + [(3, 50, "z" * 50)]


def test_quality(docs, nothing):
    rows = quality_rules(docs)
    got = by_id(rows, "n_words", "n_repeat_words", "base_failed", "kept")
    assert rows.count() == docs.count() and got[4] == got[5] == got[6] == (0, 0, True, False) and got[8][:3] == (60_025, 60_000, True)
    assert quality_filter(docs).columns == docs.columns and quality_rules(nothing).count() == 0


def test_quality_guards_and_references(spark):
    """Few words or characters say nothing about a distribution, junk that fails the base rule is no reference, and without a reference nothing is rejected."""
    import random

    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choice(["the", "of", "river", "town", "and", "boat", "in", "a", "stone", "hill", "is", "tree", f"word{i % 7}x"]) for i in range(n))
    odd = lambda n: " ".join(f"ZQ{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, plain(120), "en") for i in range(40)] + [(100, odd(90), "en"), (101, odd(24) + " " + " ".join(f"Q{i}" for i in range(30)), "en"), (102, "spam spam spam " * 4000, "en"), (103, odd(90), "de"), (104, odd(90), None)]
    got = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "base_failed", "kept", "word_distance")
    assert all(got[i][:2] == (False, True) for i in range(40)) and got[100][:2] == (False, False) and got[102][:2] == (True, False)
    assert got[103][:2] == (False, True) and got[103][2] == 0.0 and got[104] == (False, True, None)
    only = by_id(quality_rules(spark.createDataFrame([(1, "spam spam spam " * 400, "en"), (2, "few words", "en")], "doc_id long, text string, lang string")), "kept", "word_distance")
    assert only == {1: (False, None), 2: (False, None)}


def test_decontaminate(spark, docs, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and then runs"), (2, "ONE"), (3, None), (4, "..."), (2, "one"), (None, "été")], ITEMS)
    rows = decontaminate(docs, items)
    got = by_id(rows, "n_words", "n_hit", "n_items", "contaminated")
    assert rows.count() == docs.count() and got[1] == (25, 11, 1, True) and got[7] == (1, 1, 1, True) and got[4] == (0, 0, 0, False) and got[None][1] == 11 and got[8][1] == 11
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate(nothing, items).count() == 0
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 10, 11] and without_contaminated(docs, items.limit(0)).count() == docs.count()
    near = spark.createDataFrame([(1, "brown fox leaps over the lazy")], ITEMS)
    assert matches(docs, near).count() == 0
    swapped = spark.createDataFrame([(1, "brown fox over jumps the lazy")], ITEMS)
    assert matches(docs, swapped).count() == 0 and {r["doc"] for r in matches(docs, swapped, slop=2).collect()} >= {"1", "2", "3"}


def test_html(spark):
    rows = [
        (1, "u", "<nav>Home</nav><div class='cookie-notice'>We use cookies</div><article><header>By me</header><h1>T &amp; x</h1><p>First&nbsp;one.<p>Second <b>bold</b><br>line.</article><div class='comments'><p>nice post</p></div><footer>c</footer>"),
        (2, "u", None), (3, None, ""), (None, "u", "<p>plain text without any wrapper at all, but a long one that goes on for quite a while to be the main text of this page.</p>"), (3, None, "<script>x</script><style>y</style>"),
        (4, "u", "<article><p>cut off in a tag <a href=\"/x"), (5, "u", "<article>" + "<p>para.</p>" * 3000 + "</article>"),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = [(r["page_id"], r["text"]) for r in html_extract(d).collect()]
    assert got[0] == (1, "T & x\n\nFirst one.\n\nSecond bold line.") and [t for i, t in got[1:3]] == ["", ""] and got[3][1].startswith("plain text") and got[4] == (3, "") and got[5] == (4, "cut off in a tag") and got[6][1].count("para.") == 3000
    assert html_extract(d.limit(0)).count() == 0


def test_licenses(docs, nothing):
    got = by_id(license_scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got[10] == (12, 3, 0, 10, "cc-by,reserved", "cc-by,mit,reserved", 1.0) and got[4] == (0, 0, None, None, "", "", 0.0) and license_scan(docs).count() == docs.count() and license_scan(nothing).count() == 0


def labels(spark, texts):
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r["labels"] for r in got.orderBy("doc_id").collect()]


def test_licenses_alike(spark):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "This library is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl",
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa", "Released under the BSD license": "bsd",
        "Licensed under the Mozilla Public License, version 2.0": "", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
        "published by the Free Software Foundation; under the terms of the GNU General Public License, either version 3 or later": "gpl", "Apache License 2.0": "apache", "the apache tribe": "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc", "Students of the MIT wrote it, and a license came later": "", "Licensed under the Apache License, Version 2.0": "apache", "Released under the MIT License.": "mit",
    }
    assert labels(spark, want) == list(want.values())


def test_licenses_wrapped(spark):
    bsd, apache = "Redistribution and use in source and binary forms, with or without", "Licensed under the Apache License,\nVersion 2.0"
    want = {
        f"{bsd}\nmodification, are permitted provided that": "bsd", f"intro\n# {apache}": "apache", "// Subject to the terms of the Mozilla Public\n//\n\n// License, version 2.0.": "mpl",
        bsd.replace(" ", "\n") + "\nmodification\nare\npermitted": "bsd", bsd: "", bsd + "\n" + "other words here " * 20 + "\nmodification, are permitted": "",
        "licensed " + "x " * 50 + "under the apache " + "y " * 50 + "license version 2 0": "", "x " * 3000 + "licensed under the apache license version 2 0 " + "y " * 3000: "apache", "mit " * 2000 + "released under the mit license": "mit",
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software": "mit",
    }
    assert labels(spark, want) == list(want.values())


def test_mixing(docs, nothing):
    got = mix_plan(docs)
    assert got.count() == docs.count() and got.where("taken > 2 * size").count() == 0 and by_id(got, "taken")[4] == (0,)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mix_plan(docs.repartition(7)).collect()), key=repr)
    assert mix(docs).columns == docs.columns and mix_plan(nothing).count() == 0 and mix(nothing).count() == 0


def test_urls(spark):
    t = lambda d: f"2024-01-{d:02d}"
    entries = spark.createDataFrame([("Bad.com", "block", "add", t(5)), ("bad.com", "block", "remove", t(10)), ("ok.bad.com", "allow", "add", t(1)), ("bad.com", "block", "add", t(5)), (None, "block", "add", t(1)), ("x.org", "block", "add", t(3)), ("x.org", "block", "remove", t(3))], "host string, list string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows = [(1, "https://u@WWW.bad.com:8/x", t(5)), (2, "https://bad.com", t(10)), (3, "http://ok.bad.com/", t(6)), (4, "notbad.com", t(6)), (5, None, t(6)), (6, "https://bad.com", None), (1, "https://u@WWW.bad.com:8/x", t(5)), (7, "https://x.org", t(4)), (8, "https://bad.com", t(4))]
    d = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("host", F.lit("other"))
    got = {r["page_id"]: (r["matched"], r["verdict"]) for r in url_filter(d, entries).collect()}
    assert got == {1: ("bad.com", "block"), 2: (None, "keep"), 3: ("ok.bad.com", "keep"), 4: (None, "keep"), 5: (None, "keep"), 6: (None, "keep"), 7: (None, "keep"), 8: (None, "keep")}
    assert url_filter(d.limit(0), entries).count() == 0 and url_filter(d, entries.limit(0)).count() == 9


def test_lines(spark, docs, nothing):
    line = "this very line is much longer than forty characters"
    rows = [(i, f"{line.upper() if i % 2 else line} \r\nown {i}\n\t{line}") for i in range(1, 6)] + [(6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1))
    got = by_id(line_dedup(d), "n_lines", "n_dropped", "kept_text")
    assert got[1] == (3, 2, "own 1") and got[5][:2] == (3, 0) and got[6] == got[7] == (1, 0, "")
    assert line_dedup(docs).count() == docs.count() and line_dedup(nothing).count() == 0
    # Five rows of one document and one of another are two documents; rows without id are one that is never the largest.
    twice = spark.createDataFrame([(1, line)] * 5 + [(2, line)] + [(None, line)] * 3, "doc_id long, text string")
    assert by_id(line_dedup(twice), "n_dropped") == {1: (0,), 2: (0,), None: (0,)}
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup(twice, min_docs=3).collect()) == [(0, 1)] * 3 + [(1, 1)] * 5 + [(2, 0)]


@pytest.mark.parametrize("most, hot", [(32 << 20, 100_000), (100, 4), (0, 100_000)])
def test_hot_keys_meet_what_others_do(spark, docs, monkeypatch, most, hot):
    from tidemark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    monkeypatch.setattr(common, "HOT", hot)
    left = spark.createDataFrame([(k, i) for k in range(8) for i in range(k)] + [(9, 0)], "k int, i int")
    right = spark.createDataFrame([(k, k) for k in range(8)], "k int, n long")
    assert sorted(tuple(r) for r in common.join_hot(left, right, ["k"], "n", 50).collect()) == [(k, i, k) for k in range(8) for i in range(k)]
    assert sorted(tuple(r) for r in common.join_hot(left, right, ["k"], "n", 50, "left").where("n is null").collect()) == [(9, 0, None)]
    test_lines(spark, docs, docs.limit(0))
    test_urls(spark)


@pytest.mark.parametrize("limit", [100, 1000, 10**9])
def test_sharding(docs, nothing, limit):
    got = shard_plan(docs, limit).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r["depth"], r["prefix"]), []).append((r["doc_id"], r["n_bytes"], r["shard_bytes"]))
    assert len(got) == docs.count() and all(sum(x[1] for x in v) == v[0][2] for v in sizes.values()) and all(v[0][2] <= limit or len({x[0] for x in v}) == 1 for v in sizes.values())
    assert shard(docs, limit).columns == [*docs.columns, "shard"] and shard_plan(nothing, limit).count() == 0


def test_write_shards(spark, docs, tmp_path):
    write_shards(docs.select("doc_id", "text"), str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    """Every stage takes nulls, repeated rows, extra columns and empty tables, and its decisions take effect."""
    import corpus_pipeline

    spark.createDataFrame([("b", "quick brown fox jumps over the lazy dog and then runs")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in d.collect())
    some = lambda *x: sorted((i is not None, i or 0) for i in x)
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        assert out.columns == ([*docs.columns, "shard"] if name == "sharding" else docs.columns)
        assert f(spark, nothing, str(tmp_path)).count() == 0 and i < 5
    assert ids(stages["quality rules"](spark, docs, "")) == []  # each is too short or repeats itself
    assert ids(stages["n-gram Jaccard join"](spark, docs, "")) == some(None, 1, 4, 5, 6, 7, 7, 9, 10, 11)
    assert ids(stages["benchmark decontamination"](spark, docs, str(tmp_path))) == some(4, 5, 6, 7, 7, 9, 10, 11)
    assert set(ids(stages["mixing sources"](spark, docs, ""))) <= set(ids(docs)) and ids(stages["sharding"](spark, docs, "")) == ids(docs)


def test_substring_dedup_of_one_id_with_other_texts(spark):
    text = lambda n, k: "".join(chr(97 + (i * i * (k + 1) + i * k) % 26) + str(i * k % 97) for i in range(n))[:n]
    t, long, short = text(170, 2), text(400, 5), text(30, 7)
    rows = [(3, t), (3, long), (2, t), (5, long[:250]), (5, short), (5, None), (6, short)]
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substring_dedup(spark.createDataFrame(order, "doc_id long, text string"), length=100).collect())
        # The longest text stands for its id: of 5 it repeats 3's; the other texts of 3 and 5 stay whole, and none is cut by another's spans.
        assert got == [(2, 170, 0), (3, 170, 0), (3, 400, 0), (5, 0, 0), (5, 30, 0), (5, 250, 250), (6, 30, 0)]


def test_license_scan_without_ids(spark):
    rows = [(None, "Released under the MIT license"), (None, "Released under the BSD license"), (None, "nothing"), (1, "Released under the MIT license"), (1, "nothing")]
    got = sorted((r["labels"], r["n_words"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("", 1), ("", 1), ("bsd", 5), ("mit", 5), ("mit", 5)]


def test_shard_replaces_a_column_of_its_name(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "doc_id long, text string, Shard string")
    assert shard(d, 10).columns == ["doc_id", "text", "shard"] and {r["shard"] for r in shard(d, 10).collect()} == {"0-"}
    write_shards(d, str(tmp_path / "out"), 10)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sieve_and_without(spark, monkeypatch):
    from tidemark.llm import common

    rows = spark.createDataFrame([(i % 50, i, "x") for i in range(200)] + [(None, 1, "x")], "k long, `row` int, maybe string")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 7)], "k long")
    for words in (1 << 19, 1):  # one word: nearly everything is shuffled
        monkeypatch.setattr(common, "SIEVE_WORDS", words)
        out = common.without(rows, gone, {"k": F.col("k")})
        assert out.columns == rows.columns and sorted((r["k"] is None, r["k"] or 0, r["row"]) for r in out.collect()) == sorted([(False, i % 50, i) for i in range(200) if i % 50 % 7] + [(True, 0, 1)])
        assert common.without(rows, gone.limit(0), {"k": F.col("k")}).count() == 201
