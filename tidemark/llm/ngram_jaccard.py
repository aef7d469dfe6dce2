"""N-gram Jaccard join by parity sketches.

Every document is the set of 64-bit hashes of its distinct w-word shingles. A parity sketch lets each shingle
flip one position of a long bit vector, so the Hamming distance of two sketches is at most the size of the symmetric
difference of the sets. Two sets of a <= b shingles with Jaccard similarity t or more differ in at most
a * (1 - t) / t shingles and a >= t * b. So:

* size bands are laid so that linked sets are in one band or two neighbouring ones;
* for each band the sketch is cut into D + 1 + e blocks, D being the largest difference of a linked pair there: at
  least 1 + e blocks of a linked pair agree in every bit. A block travels as the 64-bit XOR of its shingles' codes
  (its parity pattern in short). e spare blocks make sure that an agreeing block isn't an empty one, unless both
  documents have more than e empty blocks, and only then are empty blocks sent;
* a document leaves out as many of its keys as it has spare blocks that aren't empty, those first that many documents
  have: a linked pair has more keys in common than that, and the last of them in an order that all documents share
  is left out by neither. So passages that many documents quote tie no documents together. The order may be any; it
  comes from counts of the keys that documents of one batch share. Documents with equal sets are found before, and
  one of them stands for all;
* equal blocks join documents into stars around the smallest doc_id of each block value; stars that meet form a
  candidate cluster, which holds every linked pair in full;
* within a cluster, tiles of bounded size meet each other once, first by dense bit sketches: pairs that their Hamming distance
  doesn't refute make closer clusters;
* within those, tiles meet again with their texts, and the sets themselves decide. Pairs that links found so far already
  connect need no test.

Documents with equal sets are one class from the start, so thousands of copies cost one row in a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import components, contiguous, mix, sieved, table

#: Documents in a tile; a task holds two tiles.
TILE = 1024
#: Least bits of a dense sketch.
SKETCH_BITS = 2048
#: Keys that are put in order by their counts, 12 bytes each; all others follow.
HOT_KEYS = 1 << 20
#: Block keys that a map task remembers, 16 bytes each; those of one more batch may come on top.
HELD = 2_000_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words between ASCII white space."""
    texts = texts.fill_null("").take(pa.array(np.arange(len(texts))))  # a copy without an offset
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = pc.list_flatten(split)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(doc):
        return out
    code = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = mix(code)[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.searchsorted(doc, np.arange(len(texts)), "right")
    starts = np.concatenate([[0], ends[:-1]])
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B185EBCA87) + h[i : i + len(rolled)]
    rolled = mix(rolled, 7)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - s >= width:
            out[i] = np.unique(rolled[s : e - width + 1])
        elif e > s:
            x = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for y in h[s:e]:
                    x = x * np.uint64(0x9E3779B185EBCA87) + y
            out[i] = mix(np.array([x]), 11)
    return out


class Bands:
    """Size bands for a threshold of num / den, with the difference and the blocks of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def upto(self, n: int) -> None:
        while self.low[-1] <= n:
            x = self.low[-1]
            self.low.append(max(x + 1, (x - 1) * self.den // self.num + 1))

    def of(self, n: int) -> int:
        self.upto(n)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def plan(self, k: int) -> tuple[int, int]:
        """Blocks and spare blocks of pairs whose smaller set is in band k."""
        self.upto(self.low[-1] if k + 1 < len(self.low) else self.low[-1] * 2)
        while k + 1 >= len(self.low):
            self.upto(self.low[-1])
        most = (self.low[k + 1] - 1) * (self.den - self.num) // self.num
        spare = 0 if most == 0 else max(2 if most < 4 else 4 if most < 16 else 8, 2 + most // 8)
        return most + 1 + spare, spare


def block_keys(s: np.ndarray, k: int, blocks: int, spare: int) -> tuple[np.ndarray, int]:
    """Join keys of one set in band k, and how many of them it may leave out; blocks are ranges of the sorted hashes."""
    at = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    code = np.bitwise_xor.reduceat(mix(s, 3), first)
    which = at[first]
    spared = spare - (blocks - len(first))
    if spared < 0:  # others may send fewer, so one key in common is all that is sure
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), which)
        code, which = np.concatenate([code, np.zeros(len(empty), np.uint64)]), np.concatenate([which, empty])
    return mix(code ^ mix(which + np.uint64(k << 32), 5), 6), max(spared, 0)


def all_keys(sets: list[np.ndarray], bands: Bands, plans: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of all sets in their two bands: (keys, which set and band each is of, how many each set and band may leave out). Set and band 2i and 2i + 1 are of set i."""
    keys, spared = [np.zeros(0, np.uint64)], np.zeros(2 * len(sets), np.int64)
    size = np.zeros(2 * len(sets), np.int64)
    for i, s in enumerate(sets):
        if len(s):
            k = bands.of(len(s))
            for j, b in ((2 * i, k), (2 * i + 1, k - 1)):
                if b >= 0:
                    if b not in plans:
                        plans[b] = bands.plan(b)
                    x, spared[j] = block_keys(s, b, *plans[b])
                    keys.append(x)
                    size[j] = len(x)
    return np.concatenate(keys), np.repeat(np.arange(len(size)), size), spared


def left_out(key: np.ndarray, of: np.ndarray, spared: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of all_keys() are left out: of each set and band the first it has in the order of rank, among the sorted keys hot, as many as are spared."""
    out = np.zeros(len(key), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        found = np.flatnonzero(hot[at] == key)
        found = found[np.lexsort((rank[at[found]], of[found]))]
        of = of[found]
        first = np.searchsorted(of, of)  # where its set and band begins
        out[found] = np.arange(len(found)) - first < spared[of]
    return out


SURVEY = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "n", "f1", "f2", "key", "hits")])


def hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets and two hashes of each."""
    return np.array([len(s) for s in sets], np.int64), np.array([(mix(s, 1).sum(), mix(s, 2).sum()) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def survey(width: int, num: int, den: int):
    """Map step over rows with an id: a row (doc, n, f1, f2) for each document, and rows (key, hits) of block keys that different sets of one batch share.

    A task remembers up to HELD of these keys; beyond that it forgets the rarer half.
    """

    def merged(parts):
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([h for _, h in parts]), len(key)).astype(np.int64)

    def run(batches):
        bands = Bands(num, den)
        plans: dict[int, tuple[int, int]] = {}
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            keys, seen = [np.zeros(0, np.uint64)], np.zeros((0, 2), np.int64)
            for at in range(0, batch.num_rows, 2000):
                sets = shingle_sets(batch.column(1).slice(at, 2000), width)
                n, f = hashes(sets)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2000), *[pa.array(np.ascontiguousarray(x)) for x in (n, f[:, 0], f[:, 1])], none, none], names=SURVEY.names)
                new = np.unique(np.concatenate([seen, f]), axis=0, return_index=True)[1] - len(seen)
                keys.append(all_keys([sets[i] for i in new[new >= 0]], bands, plans)[0])
                seen = np.concatenate([seen, f[new[new >= 0]]])
            key, hits = np.unique(np.concatenate(keys), return_counts=True)
            held.append((key[hits > 1], hits[hits > 1]))
            if sum(len(k) for k, _ in held) > HELD:
                key, hits = merged(held)
                most = np.argsort(-hits, kind="stable")[: HELD // 2]
                held = [(key[most], hits[most])]
        key, hits = merged(held)
        none = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(key.view(np.int64)), pa.array(hits)], names=SURVEY.names)

    return run


def hottest(surveyed: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to most of the keys with the most hits, sorted, and the rank of each by hits and key."""
    counts = surveyed.where("key is not null").groupBy("key").agg(F.sum("hits").alias("hits")).withColumn("step", F.floor(F.log2("hits") * 8))
    total, least = 0, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    found = counts.where(F.col("step") >= F.lit(least)).select("key", "hits").toArrow()
    key, hits = found.column("key").to_numpy().view(np.uint64), found.column("hits").to_numpy()
    order = np.lexsort((key, -hits))
    rank = np.empty(len(key), np.int32)
    rank[order] = np.arange(len(key), dtype=np.int32)
    order = np.argsort(key)
    return key[order], rank[order]


SIGNATURE = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "doc", "hub")])
SKETCH = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc", "n", "f1", "f2")], T.StructField("sketch", T.BinaryType())])


def signatures(width: int, num: int, den: int, hot: np.ndarray, rank: np.ndarray):
    """Map step over rows with an id: their block keys, but for those that are left_out().

    Documents of one task with the same key are joined here: the first to hold it goes on under the key, the others as finished
    edges (hub, doc) dealt out at random. So a key that a third of all documents share shuffles a row a task, and whatever comes
    together under one key has a row a task at most. A task remembers up to HELD keys; one beyond them shuffles a row a batch.
    """

    def run(batches):
        bands = Bands(num, den)
        plans: dict[int, tuple[int, int]] = {}
        held, hubs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 2000):
                doc = ids.slice(at, 2000).to_numpy(zero_copy_only=False)
                sets = shingle_sets(texts.slice(at, 2000), width)
                key, of, spared = all_keys(sets, bands, plans)
                keep = ~left_out(key, of, spared, hot, rank)
                key, own = key[keep], doc[of[keep] // 2]
                if not len(key):
                    continue
                order = np.lexsort((own, key))
                key, own = key[order], own[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                first, hub = key[new], own[new]
                at_held = np.minimum(np.searchsorted(held, first), max(len(held) - 1, 0))
                known = held[at_held] == first if len(held) else np.zeros(len(first), bool)
                yield _rows(first[~known], hub[~known])
                if len(held) < HELD:
                    place = np.searchsorted(held, first[~known])
                    held, earlier = np.insert(held, place, first[~known]), hubs
                    hub = np.where(known, earlier[at_held], hub) if len(earlier) else hub
                    hubs = np.insert(hubs, place, hub[~known])
                else:
                    hub = np.where(known, hubs[at_held], hub)
                hub = hub[np.cumsum(new) - 1]
                pair = np.unique(np.stack([hub, own], 1)[hub != own], axis=0)
                if len(pair):
                    yield _rows(mix(pair[:, 1].astype(np.uint64), 13), pair[:, 1], pair[:, 0])

    return run


def set_sizes(width: int):
    """Map step: the size n of each row's set, and nothing else of the row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                n = np.array([len(s) for s in shingle_sets(batch.column(0).slice(at, 2000), width)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])

    return run


def _rows(key, doc, hub=None) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(np.ascontiguousarray(doc)), pa.nulls(len(doc), pa.int64()) if hub is None else pa.array(np.ascontiguousarray(hub))]
    return pa.RecordBatch.from_arrays(columns, names=SIGNATURE.names)


def sketches(width: int):
    """Map step over rows with an id: a row (doc, n, f1, f2, sketch) for each document."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sets = shingle_sets(batch.column(1).slice(at, 2000), width)
                n, f = hashes(sets)
                drawn = pa.array([dense(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2000), *[pa.array(np.ascontiguousarray(x)) for x in (n, f[:, 0], f[:, 1])], drawn], names=SKETCH.names)

    return run


def sketch_bits(n: int) -> int:
    """Bits of a set's dense sketch: a power of two, four times its size or more."""
    return max(SKETCH_BITS, 1 << (4 * n - 1).bit_length()) if n else SKETCH_BITS


def dense(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set, packed. Its halves' XOR is the sketch of half as many bits."""
    size = sketch_bits(len(s))
    return np.packbits((np.bincount((mix(s, 17) % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8))


def may_link(n: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs sizes and sketches allow, their Hamming distances); side 2 meets all, sides 0 and 1 meet each other only.

    A linked pair differs in at most (a + b)(1 - t) / (1 + t) shingles. Sketches of unlike lengths meet at the shorter one.
    """
    size = np.array([len(x) for x in sketches])
    may = (np.minimum(n[:, None], n[None, :]) * den >= np.maximum(n[:, None], n[None, :]) * num) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    apart = np.zeros(may.shape, np.float32)
    for k in np.unique(size):
        at = np.flatnonzero((size == k) | (size == 2 * k))
        rows = np.stack([x if len(x) == k else x[:k] ^ x[k:] for x in (sketches[i] for i in at)])
        both = np.zeros((len(at), len(at)), np.float32)
        for c in range(0, k, 256):
            part = np.unpackbits(rows[:, c : c + 256], axis=1).astype(np.float32)
            both += part @ part.T
        ones = both.diagonal()
        here = np.ix_(at, at)
        apart[here] = np.where(np.minimum(size[at][:, None], size[at][None, :]) == k, ones[:, None] + ones[None, :] - 2 * both, apart[here])
    may &= apart * (den + num) <= (n[:, None] + n[None, :]) * (den - num)
    return may, apart


def sketch_links(num: int, den: int):
    """Edges of each tile pair that tie together what sketches can't tell apart: a link is always between two of one such component."""

    def run(batches):
        for whole, starts in contiguous(batches, ["cluster", "band", "i", "j"]):
            ends = [*starts[1:].tolist(), whole.num_rows]
            left, right = [], []
            for s, e in zip(starts.tolist(), ends, strict=True):
                part = whole.slice(s, e - s).combine_chunks()
                doc = part.column("doc").to_numpy()
                sketches = [np.frombuffer(x, np.uint8) for x in part.column("sketch").to_pylist()]
                may, _ = may_link(part.column("n").to_numpy(), sketches, part.column("side").to_numpy(), num, den)
                np.fill_diagonal(may, True)
                label = np.arange(len(doc))
                while True:
                    low = np.where(may, label[None, :], len(doc)).min(1)
                    if (low == label).all():
                        break
                    label = low[low]
                tied = np.flatnonzero(label != np.arange(len(doc)))
                left.append(doc[tied])
                right.append(doc[label[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def tile_links(width: int, num: int, den: int):
    """Links of each tile pair, less those that others of the pair already imply."""

    def run(batches):
        for whole, starts in contiguous(batches, ["cluster", "band", "i", "j"]):
            ends = [*starts[1:].tolist(), whole.num_rows]
            left, right = [], []
            for s, e in zip(starts.tolist(), ends, strict=True):
                part = whole.slice(s, e - s)
                doc, side = part.column("doc").to_numpy(), part.column("side").to_numpy()
                sets = [x for c in part.column("text").chunks for x in shingle_sets(c, width)]
                for a, b in links(sets, side, num, den):
                    left.append(doc[a])
                    right.append(doc[b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int):
    """Pairs of sets at num / den or more, but for those whose sets are connected by pairs before them."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    may, apart = may_link(np.array([len(s) for s in sets], np.int64), [dense(s) for s in sets], side, num, den)
    a, b = np.nonzero(np.triu(may, 1))
    order = np.argsort(apart[a, b], kind="stable")
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = find(x), find(y)
        if p == q:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if both * den >= num * (len(sets[x]) + len(sets[y]) - both):
            root[p] = q
            yield x, y


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """Rows (doc, cluster, band, i, j, side) of members (doc, cluster, band): every member in each group in which its tile meets another tile.

    A cluster of at most tile members is one group. Larger ones fall into tiles by band and hash; tiles of one band meet
    each other and those of the next band, each pair once. Clusters of one member are left out.
    """
    counts = members.groupBy("cluster", "band").agg(F.count("*").alias("m"))
    total = counts.groupBy("cluster").agg(F.sum("m").alias("all")).where("all > 1")
    counts = counts.join(total, "cluster").select("cluster", "all", "band", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    around = counts.alias("c").join(counts.alias("u"), (F.col("c.cluster") == F.col("u.cluster")) & (F.col("u.band") == F.col("c.band") + 1), "left")
    around = around.join(counts.alias("d"), (F.col("c.cluster") == F.col("d.cluster")) & (F.col("d.band") == F.col("c.band") - 1), "left")
    around = around.select("c.cluster", "c.all", "c.band", "c.tiles", F.coalesce("u.tiles", F.lit(0)).alias("up"), F.coalesce("d.tiles", F.lit(0)).alias("down"))

    def group(band, i, j, side) -> F.Column:
        return F.struct(band.cast("int").alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def upto(n) -> F.Column:
        return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    r = F.col("r")
    spread = F.concat(
        F.transform(upto(F.col("tiles")), lambda x: group(F.col("band") * 2, F.least(x, r), F.greatest(x, r), F.when(x == r, 2).when(x > r, 0).otherwise(1))),
        F.transform(upto(F.col("up")), lambda x: group(F.col("band") * 2 + 1, r, x, F.lit(0))),
        F.transform(upto(F.col("down")), lambda x: group(F.col("band") * 2 - 1, x, r, F.lit(1))),
    )
    one = F.array(group(F.lit(-9), F.lit(0), F.lit(0), F.lit(2)))
    rows = members.join(around, ["cluster", "band"]).withColumn("r", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    return rows.select("doc", "cluster", F.explode(F.when(F.col("all") <= tile, one).otherwise(spread)).alias("g")).select("doc", "cluster", "g.*")


def together(rows: DataFrame) -> DataFrame:
    """rows dealt out and sorted by group."""
    return rows.repartition("cluster", "band", "i", "j").sortWithinPartitions("cluster", "band", "i", "j")


def ngram_jaccard(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """A row (doc_id, n_shingles, component_id) for each document.

    Ids are whole numbers. Two documents link when den * |A and B| >= num * |A or B| over their sets of distinct width-word shingles; fewer words
    count as one shingle, and null, empty or blank texts as the empty set, which links with nothing. component_id is the
    smallest doc_id that links reach. Rows of one doc_id are one node of the graph. A null doc_id never links: its
    component is null and its size is that of its text;
    otherwise a doc_id has one row, with the largest of its sets' sizes. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = docs.where("doc is not null")
    surveyed = table(known.mapInArrow(survey(width, num, den), SURVEY), "jaccard-survey")
    sizes = surveyed.where("n is not null").select("doc", "n", "f1", "f2")
    first = table(sizes.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep")), "jaccard-first")
    # Equal sets have equal keys, so the first is enough; some more that the sieve lets through do no harm.
    reps = sieved(known, first.select(F.col("rep").alias("doc")), ["doc"]).where("maybe").select("doc", "text")
    rows = reps.mapInArrow(signatures(width, num, den, *hottest(surveyed, HOT_KEYS)), SIGNATURE)
    low = F.min(F.when(F.col("hub").isNull(), F.col("doc"))).over(Window.partitionBy("key"))
    met = rows.select("doc", F.coalesce("hub", low).alias("hub")).where("hub <> doc")
    clusters = components(met.select(F.col("doc").alias("a"), F.col("hub").alias("b")), "jaccard-cluster")
    bands = Bands(num, den)
    bands.upto(sizes.agg(F.max("n")).first()[0] or 1)
    band = sum(((F.col("n") >= x).cast("int") for x in bands.low if x > 1), F.lit(0))
    members = clusters.join(first, F.col("node") == F.col("rep")).select(F.col("rep").alias("doc"), F.col("component").alias("cluster"), band.alias("band"), "n", "f1", "f2")
    members = table(members, "jaccard-member")
    drawn = sieved(known, members, ["doc"]).where("maybe").select("doc", "text").mapInArrow(sketches(width), SKETCH).dropDuplicates(["doc", "n", "f1", "f2"])
    members = table(members.join(drawn, ["doc", "n", "f1", "f2"]), "jaccard-member")
    near = together(members.select("doc", "n", "sketch").join(tiled(members, tile), "doc")).mapInArrow(sketch_links(num, den), "a long, b long")
    close = components(near, "jaccard-close")
    members = table(members.select("doc", "band").join(close.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc"), "jaccard-member")
    # Only texts that a sieve of the members lets through are shuffled, at every size.
    texts = sieved(docs, members, ["doc"]).where("maybe").select("doc", "text")
    found = table(together(texts.join(tiled(members, tile).hint("merge"), "doc")).mapInArrow(tile_links(width, num, den), "a long, b long"), "jaccard-link")
    same = sizes.join(first, ["n", "f1", "f2"]).where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    final = components(found.unionByName(same), "jaccard-component")
    ids = sizes.groupBy("doc").agg(F.max("n").alias("n"))
    out = ids.join(final, ids.doc == final.node, "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    lost = docs.where("doc is null").select("text").mapInArrow(set_sizes(width), "n long")  # never met with others, so equal ones all stay
    return out.unionByName(lost.select(F.lit(None).cast("long").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
