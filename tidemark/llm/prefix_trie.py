"""Conversation prefix trie.

A node is a sequence of first turns, known by its depth and two XOR sums of position-salted turn hashes; so a conversation's path of nodes is a
running value over its turns, computed in range-sorted partitions with a carry of one row a partition, however long one conversation is.
Partial tries are merged by key in rounds of FAN, which adds up members before and after each shuffle. The ids that end at a node are merged
as sorted runs and hashed as a stream, a bounded run at a time.

The rollup goes from the bottom over paths instead of levels. Nodes of the same smallest member are one downward path, so the trie is a tree of
at most as many paths as there are conversations. Sums of whole paths climb this tree by pointer doubling, log2 of its nesting rounds,
and a running sum from the end of each path then gives every node its own subtree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ceil_div, join_hot, table

#: Partial tries that one merge takes together, and ids in a run of an end list.
FAN, RUN = 64, 2048
KEY = ["depth", "x1", "x2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _accumulate(key: str, sums: list[str], xors: list[str]):
    def run(batches):
        part, last, held, carry = TaskContext.get().partitionId(), None, None, {c: 0 for c in [*sums, *xors]}
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = last is None or k[0] != last
            last, starts, group = k[-1], np.flatnonzero(new), np.cumsum(new)
            names, columns = list(batch.schema.names), list(batch.columns)
            for c in [*sums, *xors]:
                v = batch.column(batch.schema.get_field_index(c)).to_numpy()
                if c in sums:
                    a = np.cumsum(v)
                    a -= np.concatenate([[-carry[c]], a[starts] - v[starts]])[group]
                else:
                    a = np.bitwise_xor.accumulate(v)
                    a ^= np.concatenate([[carry[c]], a[starts] ^ v[starts]])[group]
                carry[c] = int(a[-1])
                names.append(f"run_{c}")
                columns.append(pa.array(a))
            if held is not None:
                yield _marked(*held, part, False)
            held = columns, names
        if held is not None:
            yield _marked(*held, part, True)

    return run


def _marked(columns: list, names: list[str], part: int, final: bool) -> pa.RecordBatch:
    n = len(columns[0])
    open_ = np.zeros(n, bool)
    open_[-1] = final
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(open_)], names=[*names, "part", "open"])


def running(rows: DataFrame, key: str, order: list[Column], keep: list[str], name: str, sums: list[str] = [], xors: list[str] = []) -> DataFrame:
    """Columns keep of rows with run_<c>, the running sum or XOR (itself included) of each long column c of sums and xors within key by order, and part, the partition.

    Rows are dealt out by ranges of key and order, so a key of any size is spread. What a partition's last key has so far is a row for each
    partition; these rows, no others, are put in one order and broadcast.
    """
    ordered = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*keep)
    runs = [f"run_{c}" for c in [*sums, *xors]]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema], *[f"{c} long" for c in runs], "part int", "open boolean"])
    local = table(ordered.mapInArrow(_accumulate(key, sums, xors), schema), name)
    so_far = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    add = [(F.sum(c) if c[4:] in sums else F.bit_xor(c)).over(so_far).alias(f"past_{c}") for c in runs]
    past = local.where("open").select(F.col(key), F.lead("part").over(Window.orderBy("part")).alias("part"), *add).where("part is not null")
    out = local.join(F.broadcast(past), [key, "part"], "left")
    join = lambda c: (F.col(c) + F.coalesce(f"past_{c}", F.lit(0)) if c[4:] in sums else F.col(c).bitwiseXOR(F.coalesce(f"past_{c}", F.lit(0)))).alias(c)
    return out.select(*keep, *[join(c) for c in runs], "part")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, at, h1, h2, chars): the place in the conversation from 1, two hashes of role and text, and the code points of the text.

    Turns are ordered by turn, null first, equal ones by role and text; null role and text are empty. Rows without conv_id belong to no
    conversation and are left out; repeated rows are turns of their own. Other columns are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("at"))
    rows = rows.withColumns({"h1": half(1), "h2": half(16)})
    out = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id", "h1", "h2", "chars", "at"], "trie-turns", sums=["at"])
    return out.select("conv_id", F.col("run_at").alias("at"), "h1", "h2", "chars")


def forked(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: each conv_id c gets the first h turns of conversation c - c % every (all if fewer, none if absent), then its own after its first h, h = crc32(c) % (most + 1).

    turns is numbered(). Returns turns (conv_id, depth, h1, h2, chars, last) and members (conv_id, n): the turns that each conversation has now, 0 among them.
    A base lends at most `most` turns to 2 * every - 1 conversations, so the join is bounded whatever repeats.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).join(base, "base", "left")
    convs = convs.select("conv_id", "own", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"))
    convs = table(convs.withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-members")
    kept = join_hot(turns, convs.select("conv_id", "h", "lent", "n", "own"), ["conv_id"], "own", 40).where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("depth"), "h1", "h2", "chars", "n")
    heads = turns.where(f"at <= {most} and conv_id % {every} = 0").select(F.col("conv_id").alias("base"), "at", "h1", "h2", "chars")
    lent = convs.where("lent > 0").join(heads, "base").where("at <= lent").select("conv_id", F.col("at").alias("depth"), "h1", "h2", "chars", "n")
    rows = kept.unionByName(lent).withColumn("last", F.col("depth") == F.col("n")).drop("n")
    return rows, convs.select("conv_id", "n")


def _runs(batches):
    """Ids sorted within nodes -> rows (node, first id, up to RUN ids joined)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for c in KEY:
            k = batch.column(batch.schema.get_field_index(c)).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        inside = np.arange(batch.num_rows) - starts[np.cumsum(new) - 1]
        starts = np.flatnonzero(inside % RUN == 0)
        ids = batch.column(batch.schema.get_field_index("conv_id"))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), ids.cast(pa.string()))
        first = batch.take(pa.array(starts))
        yield pa.RecordBatch.from_arrays([*[first.column(batch.schema.get_field_index(c)) for c in [*KEY, "conv_id"]], pc.binary_join(lists, ",")], names=[*KEY, "first", "ids"])


def _digests(batches):
    """Runs sorted by node and first id -> a row (node, digest); the state is one digest."""
    now, state, found = None, None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if row[:3] != now:
                if now is not None:
                    found.append((*now, state.hexdigest()))
                now, state = row[:3], hashlib.sha256(row[4].encode())
            else:
                state.update(b"," + row[4].encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=[*KEY, "digest"])
            found = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*KEY, "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, digest): SHA-256 of the ids (conv_id) that end at each node, ascending, joined by commas.

    A node's ids are sorted in as many tasks as they need; what meets in one task for a node are its runs, as a hash takes them in order.
    """
    runs = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_runs, "depth long, x1 long, x2 long, first long, ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, x1 long, x2 long, digest string")


def merged(nodes: DataFrame, parts: int) -> DataFrame:
    """One trie out of `parts` partial ones: rows (node, salts g1, g2, chars, conv_id, n_convs, part) are combined in each task, then by key in rounds that take FAN tries together."""
    while True:
        nodes, parts = nodes.withColumn("part", F.expr(f"part div {FAN}")), ceil_div(parts, FAN)
        by = [*KEY, "part"] if parts > 1 else KEY
        nodes = nodes.groupBy(*by).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *[F.max(c).alias(c) for c in ("g1", "g2", "chars")])
        if parts <= 1:
            return nodes


def rolled_up(paths: DataFrame) -> DataFrame:
    """(conv_id, up, leaves, saved) -> the same with sums over each path and all that hang on it.

    After round k a path has the sums of what is less than 2^k paths below it, and up is the path 2^k above.
    """
    while not paths.where("up is not null").isEmpty():
        given = paths.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        to = given.join(paths.select("conv_id", F.col("up").alias("next")), "conv_id").select(F.col("conv_id").alias("up"), "next", "n")
        climbed = paths.where("up is null").withColumn("next", F.lit(None).cast("long")).unionByName(join_hot(paths.where("up is not null"), to, ["up"], "n", 24).drop("n"))
        new = climbed.join(given.drop("n"), "conv_id", "left")
        add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        paths = table(new.select("conv_id", F.col("next").alias("up"), add("leaves", "l"), add("saved", "s")), "trie-climb")
    return paths


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of conversations: a row for each distinct sequence of first turns, the root without turns included.

    turns: (conv_id, depth, h1, h2, chars, last), depth from 1 without gaps, last on a conversation's last turn. members: (conv_id, n), all conversations with their number of turns, also 0.
    Returns, long: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes in
    the subtree), saved_tokens (sum over the subtree of (n_convs - 1) * chars), and ends_sha256 (of the ids whose conversation ends here).
    Without members there is no node at all.
    """
    salted = turns.withColumns({"g1": F.xxhash64("depth", "h1"), "g2": F.xxhash64("depth", "h2")})
    rows = running(salted, "conv_id", [F.col("depth")], ["conv_id", "depth", "g1", "g2", "chars", "last"], "trie-paths", xors=["g1", "g2"])
    rows = rows.select("conv_id", "depth", F.col("run_g1").alias("x1"), F.col("run_g2").alias("x2"), "g1", "g2", "chars", "last", "part")
    zero = F.lit(0).cast("long")
    root = lambda m: m.select("conv_id", *[zero.alias(c) for c in KEY])
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    tops = root(members).withColumns({"g1": zero, "g2": zero, "chars": zero, "part": F.pmod(F.col("conv_id"), F.lit(parts)).cast("int")})
    nodes = table(merged(rows.drop("last").unionByName(tops).withColumn("n_convs", F.lit(1).cast("long")), parts), "trie-nodes")
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    digests = end_digests(rows.where("last").select(*KEY, "conv_id").unionByName(root(members.where("n = 0")).select(*KEY, "conv_id")))

    paths = nodes.groupBy("conv_id").agg(F.min(F.struct(*KEY, "g1", "g2")).alias("top"), F.max("depth").alias("end"), F.sum("saved").alias("saved"))
    above = ["pd", "p1", "p2"]
    paths = paths.select("conv_id", "end", "saved", F.col("top.depth").alias("top"), F.when(F.col("top.depth") > 0, F.col("top.depth") - 1).alias("pd"), F.col("top.x1").bitwiseXOR(F.col("top.g1")).alias("p1"), F.col("top.x2").bitwiseXOR(F.col("top.g2")).alias("p2"))
    paths = table(paths, "trie-tops")
    hung = paths.where("pd is not null").groupBy(*above).agg(F.count("*").alias("n"))
    hung = hung.join(nodes.select(F.col("depth").alias("pd"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("up")), above)
    paths = paths.where("pd is null").withColumn("up", F.lit(None).cast("long")).unionByName(join_hot(paths.where("pd is not null"), hung, above, "n", 40).drop("n"))
    paths = table(paths.drop("p1", "p2"), "trie-up")
    bare = hung.select(F.col("up").alias("conv_id"), F.col("pd").alias("end"), F.lit(1).alias("holds"))
    start = paths.join(bare, ["conv_id", "end"], "left").select("conv_id", "up", F.when(F.col("holds").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    totals = rolled_up(table(start, "trie-climb"))
    hangs = paths.where("up is not null").select("conv_id", "up", "pd").join(totals.select("conv_id", "leaves", "saved"), "conv_id")
    side = hangs.groupBy(F.col("up").alias("conv_id"), F.col("pd").alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    none = [F.lit(None).cast("long").alias(c) for c in ("hung", "leaves", "more")]
    marks = paths.select("conv_id", F.explode(F.array(F.struct(F.col("top").alias("depth"), F.lit(True).alias("top"), F.lit(False).alias("end"), F.col("up")), F.struct(F.col("end").alias("depth"), F.lit(False).alias("top"), F.lit(True).alias("end"), F.col("up")))).alias("m"))
    side = side.withColumns({"top": F.lit(False), "end": F.lit(False), "up": F.lit(None).cast("long")}).unionByName(marks.select("conv_id", "m.*", *none))
    side = side.groupBy("conv_id", "depth").agg(F.sum("hung").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("more").alias("more"), F.bool_or("top").alias("top"), F.bool_or("end").alias("end"), F.max("up").alias("up"))
    full = nodes.join(side, ["conv_id", "depth"], "left").join(digests, KEY, "left")
    n = lambda c: F.coalesce(c, zero)
    inner = F.when(F.coalesce("end", F.lit(False)), zero).otherwise(F.lit(1).cast("long"))
    full = full.select(
        "conv_id", "depth", F.when(F.coalesce("top", F.lit(False)), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", (n("hung") + inner).alias("n_children"),
        (n("leaves") + F.when(n("hung") + inner == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved") + n("more")).alias("saved"), F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = running(full, "conv_id", [F.col("depth").desc()], full.columns, "trie", sums=["leaves", "saved"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of the conversations that forked() makes of a table (conv_id, turn, role, text)."""
    return prefix_trie(*forked(numbered(conversations)))
