"""Removal of repeated byte strings: every byte covered by a string of `length` bytes that also starts earlier.

Sorting all suffixes takes a row for each byte, several times the input on disk. What is sorted here is a sample chosen by
content: each window of `length` bytes belongs to the least hashed `gram`-byte string inside it, so equal windows belong to equal
strings at equal distances, and consecutive windows with the same one form a run (about one in (length - gram + 2) / 2 bytes).

1. Runs meet by their string's hash. One that is alone can't repeat and is dropped.
2. Runs that agree in all their bytes are wholly repeated, but for the first; those of one batch meet before the shuffle. If a string
   has one kind of run only, that settles it.
3. What is left is a bucket of runs around one string that differ somewhere. Their windows are sorted by bucket, one block of whole
   buckets at a time in a task; the first of equal windows stays. Buckets over BUCKET runs, and strings that are frequent in a batch, are
   dealt out window by window instead, equal ones of one batch being met before the shuffle, so no bucket has to fit a task.
4. Covered spans meet their document again, which is cut.

Windows are compared by a 64-bit polynomial hash over random byte codes within the bucket of an equal 64-bit string hash, and those that
are dealt out, which may be very many, by a second one over other codes as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import contiguous, mix, small, table, utf8

GRAM = 24
#: Runs of a bucket that one task sorts at most.
BUCKET = 20_000
#: Different runs of one string in a batch from which the string counts as frequent and is dealt out by windows at once, and from which a
#: batch is counted at all; strings with more than BUCKET runs in such batches are frequent as well.
FREQUENT, COUNTED = 64, 8
#: Window starts worked on at a time; 22 bits of a sort key hold a place in such a piece.
PIECE = 1 << 18
PLACE = np.uint64((1 << 22) - 1)

_powers: dict[str, np.ndarray] = {}


def _tables(n: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sets of codes of the bytes, and at least n powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            _powers["code"] = np.stack([mix(np.arange(256, dtype=np.uint64), seed) for seed in (21, 22)])
            for name, x in (("up", base), ("down", pow(base, -1, 2**64))):
                _powers[name] = np.full(size, x, np.uint64)
                _powers[name][0] = 1
                np.cumprod(_powers[name], out=_powers[name])
    return _powers["code"], _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    code, _, down = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[which][data] * down[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], whatever stands around it."""
    return (sums[end] - sums[start]) * _tables(len(sums))[1][start]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row numbers, begin of each in data, their window starts as [from, to) in data) of pieces of up to PIECE bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1, row + 1)
        if last == row + 1 and offsets[last] - offsets[row] > PIECE:
            for at in range(int(offsets[row]), int(offsets[last]), PIECE):
                yield np.array([row]), np.array([offsets[row]]), np.array([at]), np.array([min(at + PIECE, offsets[last])]), min(at + PIECE + length - 1, int(offsets[last]))
        else:
            yield np.arange(row, last), offsets[row:last], offsets[row:last], offsets[row + 1 : last + 1], int(offsets[last])
        row = last


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """For each piece: (row, start in its document, windows, string hash, hash of all the run's bytes, begin in data) of its runs."""
    for rows, begins, lows, highs, stop in pieces(data, offsets, length):
        base = int(lows[0])
        part = data[base:stop]
        if len(part) < length:
            continue
        sums = prefix_sums(part)
        at = np.arange(len(part) - gram + 1)
        grams = mix(span_hash(sums, at, at + gram), 23)
        key = (grams & ~PLACE) | at.astype(np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        place = (key & PLACE).astype(np.int64)
        # A window has to end in its own document, and starts in this piece.
        ends = highs if len(rows) > 1 else np.array([stop])
        row = np.searchsorted(ends - base, np.arange(len(place)), "right")
        row = np.minimum(row, len(rows) - 1)
        good = np.arange(len(place)) + length <= (ends - base)[row]
        good &= np.arange(len(place)) < (highs - base)[row]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        bad = np.flatnonzero(~good)
        edge = np.concatenate([first[1:], [len(place)]])
        if len(bad):
            near = np.searchsorted(bad, first)
            edge = np.minimum(edge, np.where(near < len(bad), bad[np.minimum(near, len(bad) - 1)], len(place)))
        count = edge - first
        whole = span_hash(sums, first, edge - 1 + length)
        shape = ((place[first] - first) << 20 | count).astype(np.uint64)
        yield rows[row[first]], first + base - begins[row[first]], count, grams[place[first]], mix(whole ^ mix(shape, 25), 26), first + base


RUN = "g long, whole long, doc long, start long, count long, done boolean"


def batch_runs(batch: pa.RecordBatch, length: int, gram: int):
    """(own, start, count, g, whole, done) of a batch's runs by string hash g: done are those that agree in all bytes with an earlier run of the batch."""
    doc = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = utf8(batch.column(1))
    found = list(runs(data, offsets, length, gram))
    if not found:
        return None
    row, start, count, g, whole = (np.concatenate([x[i] for x in found]) for i in range(5))
    own = doc[row]
    order = np.lexsort((start, own, whole, g))
    own, start, count, g, whole = own[order], start[order], count[order], g[order], whole[order]
    return own, start, count, g, whole, np.concatenate([[False], (g[1:] == g[:-1]) & (whole[1:] == whole[:-1])])


def frequent_strings(length: int, gram: int, least: int):
    """Map step: strings with at least `least` different runs in a batch, and how many. Whatever a few thousandths of all documents hold in different contexts is among them."""

    def run(batches):
        for batch in batches:
            found = batch_runs(batch, length, gram)
            if found:
                g, n = np.unique(found[3][~found[5]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["g", "n"])

    return run


def list_runs(length: int, gram: int):
    """Map step: every run with its string hash g. Of runs of one batch that agree in all bytes the first goes on under g; the others
    are done, being repeated as a whole, and are dealt out at random. So copies by the thousand shuffle a row a batch."""

    def run(batches):
        for batch in batches:
            found = batch_runs(batch, length, gram)
            if not found:
                continue
            own, start, count, g, whole, done = found
            g = np.where(done, mix(own.view(np.uint64) ^ mix(start.view(np.uint64), 31), 32), g)
            for at in range(0, len(g), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (g.view(np.int64), whole.view(np.int64), own, start, count, done)], names=["g", "whole", "doc", "start", "count", "done"])

    return run


def cut_runs(batches):
    """The bytes of listed runs, from rows (doc, text, todo: array of (start, count, g, many))."""
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column(1))
        todo = batch.column(2)
        which = np.repeat(np.arange(len(todo)), np.diff(todo.offsets.to_numpy()))
        flat = todo.flatten()
        start, count = flat.field("start").to_numpy(zero_copy_only=False), flat.field("count").to_numpy(zero_copy_only=False)
        length = flat.field("length").to_numpy(zero_copy_only=False)
        begin = offsets[:-1][which] + start
        for at in range(0, len(which), 20_000):
            here = slice(at, at + 20_000)
            size = count[here] - 1 + length[here]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(begin[here], size)
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[index])])
            yield pa.RecordBatch.from_arrays([flat.field("g")[here], pa.array(doc[which[here]]), pa.array(start[here]), pa.array(count[here]), raw, flat.field("many")[here]], names=["g", "doc", "start", "count", "raw", "many"])


def _windows(part: pa.Table, length: int, twice: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, row, place in the run) of every window of the runs of a table, and a second hash if asked for."""
    raw = part.column("raw").combine_chunks()
    raw = raw.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = part.column("count").to_numpy()
    g = mix(part.column("g").to_numpy().view(np.uint64), 27)
    hashes, rows, places, again = [], [], [], []
    row = 0
    while row < len(count):
        last = max(int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1, row + 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        sums = prefix_sums(data[lo:hi])
        n = count[row:last]
        which = np.repeat(np.arange(row, last), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[which] - lo + place
        hashes.append(mix(span_hash(sums, at, at + length) ^ g[which], 28))
        rows.append(which)
        places.append(place)
        if twice:
            again.append(span_hash(prefix_sums(data[lo:hi], 1), at, at + length))
        row = last
    return tuple(np.concatenate(x) for x in ((hashes, rows, places, again) if twice else (hashes, rows, places)))


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Covered spans (doc, start, end) of repeated windows, touching ones put together."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc", "start", "end"])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last] + length)], names=["doc", "start", "end"])


def sort_buckets(length: int):
    """Reduce step over runs sorted by string hash: spans of windows that are not the first of their kind."""

    def block(part: pa.Table):
        h, row, place = _windows(part, length)
        doc, start = part.column("doc").to_numpy()[row], part.column("start").to_numpy()[row] + place
        order = np.lexsort((start, doc, h))
        again = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        return _spans(doc[order][again], start[order][again], length)

    def run(batches):
        for whole, starts in contiguous(batches, ["g"]):
            ends = [*starts[1:].tolist(), whole.num_rows]
            at = 0
            for s, e in zip(starts.tolist(), ends, strict=True):
                if e - at >= 8000 or e == whole.num_rows:
                    yield block(whole.slice(at, e - at).combine_chunks())
                    at = e

    return run


def deal_windows(length: int):
    """Map step for large buckets: rows (h, w, doc, start, done), h and w being two hashes of a window. Equal windows of a batch leave one, the first, to be dealt; the others are done: repeated."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 8000):
                part = pa.Table.from_batches([batch.slice(a, 8000)])
                h, row, place, w = _windows(part, length, True)
                doc, start = part.column("doc").to_numpy()[row], part.column("start").to_numpy()[row] + place
                order = np.lexsort((start, doc, w, h))
                h, w, doc, start = h[order], w[order], doc[order], start[order]
                again = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1])])
                key = np.where(again, mix(h ^ mix(doc.view(np.uint64) ^ mix(start.view(np.uint64)))), h)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(w.view(np.int64)), pa.array(doc), pa.array(start), pa.array(again)], names=["h", "w", "doc", "start", "done"])

    return run


def meet_windows(length: int):
    """Reduce step for large buckets over rows sorted by (h, w, done, doc, start)."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, w, doc, start = (batch.column(i).to_numpy() for i in range(4))
            done = batch.column(4).to_numpy(zero_copy_only=False)
            again = np.concatenate([[(h[0], w[0]) == last], (h[1:] == h[:-1]) & (w[1:] == w[:-1])]) | done
            last = (h[-1], w[-1])
            yield _spans(doc[again], start[again], length)

    return run


def cut_documents(batches):
    """(doc, text, spans) to what is left of each document."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        spans = batch.column(2)
        at = spans.offsets.to_numpy()
        flat = spans.flatten()
        start, end = flat.field("start").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
        none = spans.is_null().to_numpy(zero_copy_only=False)
        gone, pieces_, kept = [], [], []
        at = at - at[0]
        for i in range(len(spans)):
            raw = data[offsets[i] : offsets[i + 1]]
            n = 0 if none[i] else at[i + 1] - at[i]
            if not n:
                gone.append(0)
                pieces_.append(0)
                kept.append(raw.tobytes())
                continue
            s, e = start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.concatenate([[True], s[1:] > e[:-1]])
            first = np.flatnonzero(new)
            s, e = s[first], e[np.concatenate([first[1:] - 1, [len(e) - 1]])]
            keep = np.ones(len(raw) + 1, np.int8)
            keep[:] = 0
            np.add.at(keep, s, 1)
            np.add.at(keep, e, -1)
            mask = np.cumsum(keep[:-1]) > 0
            gone.append(int(mask.sum()))
            pieces_.append(len(s))
            kept.append(raw[~mask].tobytes())
        sizes = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(gone, pa.int64()), pa.array(pieces_, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """Spans (doc, start, end) of rows (doc, text) that repeat earlier bytes; they may overlap."""
    often = docs.mapInArrow(frequent_strings(length, gram, min(FREQUENT, COUNTED)), "g long, n long").groupBy("g").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    often = table(often.where((F.col("most") >= FREQUENT) | (F.col("n") > BUCKET)).select("g", F.lit(True).alias("often")), "repeat-frequent")
    listed = docs.mapInArrow(list_runs(length, gram), RUN).join(small(often, 16), "g", "left").withColumn("often", F.coalesce(F.col("often") & ~F.col("done"), F.lit(False)))
    listed = listed.withColumn("key", F.when(F.col("often"), F.xxhash64("doc", "start")).otherwise(F.col("g")))  # frequent strings' runs needn't meet here
    by = Window.partitionBy("key")
    kind = F.coalesce(F.lag("whole").over(by.orderBy("whole", "doc", "start")) != F.col("whole"), F.lit(True))
    listed = listed.withColumn("first", kind & ~F.col("done"))
    listed = listed.withColumn("many", F.when(F.col("often"), F.lit(BUCKET + 1)).otherwise(F.sum(F.col("first").cast("long")).over(by)))
    listed = listed.withColumn("first", F.col("first") | F.col("often")).where("not first or many > 1")
    listed = table(listed.select("g", "doc", "start", "count", "many", "first"), "repeat-run")
    copies = listed.where("not first").select("doc", "start", (F.col("start") + F.col("count") - 1 + length).alias("end"))
    mixed = listed.where("first")
    todo = mixed.groupBy("doc").agg(F.collect_list(F.struct("start", "count", F.lit(length).cast("long").alias("length"), "g", "many")).alias("todo"))
    cut = docs.join(todo, "doc").mapInArrow(cut_runs, "g long, doc long, start long, count long, raw binary, many long")
    cut = table(cut, "repeat-bytes")
    span = "doc long, start long, end long"
    sorted_ = cut.where(F.col("many") <= BUCKET).drop("many").repartition("g").sortWithinPartitions("g").mapInArrow(sort_buckets(length), span)
    dealt = cut.where(F.col("many") > BUCKET).drop("many").mapInArrow(deal_windows(length), "h long, w long, doc long, start long, done boolean")
    dealt = dealt.repartition("h").sortWithinPartitions("h", "w", "done", "doc", "start").mapInArrow(meet_windows(length), span)
    return copies.unionByName(sorted_).unionByName(dealt)


def standing(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known (doc, text) with one row for each id, and known itself with held: whether a row's text is the one that stands for its id.

    That is the longest of an id's texts, the last in byte order of equally long ones. Only ids that come twice are compared.
    """
    twice = table(known.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeat-twice")
    if twice.isEmpty():
        return known, known.withColumn("held", F.lit(True))
    text = F.coalesce("text", F.lit(""))
    first = known.join(small(twice, 16), "doc", "left_semi").groupBy("doc").agg(F.max(F.struct(F.octet_length(text).alias("n"), text.alias("text"))).alias("m"))
    first = table(first.select("doc", "m.text"), "repeat-first")
    marked = known.join(first.withColumnRenamed("text", "first"), "doc", "left").select("doc", "text", (F.col("first").isNull() | (text == F.col("first"))).alias("held"))
    return known.join(small(twice, 16), "doc", "left_anti").unionByName(first), marked


def substring_dedup(docs: DataFrame, length: int = 100, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs; kept holds the bytes that stay.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of length bytes that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same one; strings may overlap and never cross documents. Ids are whole numbers. Rows that repeat as a whole count once and have
    one result each. Of different texts with one doc_id the longest stands for the document; the other texts stay as they are and are held against
    nothing, as are rows without id. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    once, marked = standing(rows.where("doc is not null"))
    spans = table(repeated_spans(once, length, gram), "repeat-span")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = marked.join(spans, "doc", "left").select("doc", "text", F.when(F.col("held"), F.col("spans")).alias("spans"))
    lost = rows.where("doc is null").select("doc", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    out = joined.unionByName(lost).mapInArrow(cut_documents, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc", id_col)
