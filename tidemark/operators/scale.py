"""Ordered folds and global ranks that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def pylist(column: pa.Array) -> list:
    """column.to_pylist(), made by columns: equal strings of a batch are one object, and maps, structs and lists are cut from their parts as a whole. Maps are dicts."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if column.null_count and pa.types.is_nested(kind):
        valid = iter(pylist(column.drop_null()))
        return [next(valid) if ok else None for ok in column.is_valid().to_numpy(zero_copy_only=False).tolist()]
    if pa.types.is_string(kind):
        coded = column.dictionary_encode()
        words = [*coded.dictionary.to_pylist(), None]
        return [words[i] for i in coded.indices.fill_null(len(words) - 1).to_numpy().tolist()]
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        at = column.offsets.to_numpy().tolist()
        part = lambda x: pylist(x.slice(at[0], at[-1] - at[0]))
        cuts = [(a - at[0], z - at[0]) for a, z in zip(at, at[1:])]  # noqa: B905, RUF007
        if pa.types.is_list(kind):
            values = part(column.values)
            return [values[a:z] for a, z in cuts]
        names, values = part(column.keys), part(column.items)
        return [dict(zip(names[a:z], values[a:z])) for a, z in cuts]  # noqa: B905
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        return [dict(zip(names, r)) for r in zip(*map(pylist, column.flatten()), strict=True)]  # noqa: B905
    return column.to_pylist()


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows dealt out by keys into as many partitions as the session shuffles into: Spark joins small ones, which is wrong for rows that are small and make many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with all of a key in one partition, sorted by key and order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], uses: Sequence[str], machine: Callable, added: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """rows with the columns added (name to type), which a state machine gives to each key's rows in order; keep names the columns wanted, if not all.

    machine() makes a key's first state; its step(*values of uses) takes one row and returns the values added. Keys are dealt out and sorted by
    Spark, and batches run through the fold one after the other, so memory is a batch and one state, however many rows a key has.
    """
    return folded(dealt(rows, keys, order), keys, uses, machine, added, keep)


def folded(rows: DataFrame, keys: Sequence[str], uses: Sequence[str], machine: Callable, added: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """in_order() for rows that are dealt() already."""
    names = list(keep or [*rows.columns, *added])
    given = [n for n in names if n not in added]
    told = [(i, n, _ARROW[t]) for i, (n, t) in enumerate(added.items()) if n in names]
    fields = [rows.schema[n] for n in given] + [T.StructField(n, T._parse_datatype_string(added[n])) for _, n, _ in told]
    rows = rows.select(*dict.fromkeys([*keys, *uses, *given]))
    at = lambda some: [rows.columns.index(c) for c in some]
    key_at, use_at, given_at = at(keys), at(uses), at(given)

    def run(batches):
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = zip(*[pylist(batch.column(i)) for i in key_at], strict=True)
            values = zip(*[pylist(batch.column(i)) for i in use_at], strict=True)
            out = []
            for k, v in zip(key, values, strict=True):
                if state is None or k != now:
                    now, state = k, machine()
                out.append(state.step(*v))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in given_at], *[pa.array(columns[i], t) for i, _, t in told]], names=[*given, *[n for _, n, _ in told]])

    return rows.mapInArrow(run, T.StructType(fields)).select(*names)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the folder of spark.checkpoint.dir, read back: lineage is cut, and a lost executor costs its tasks only. A local session without that folder gets one."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(rows: DataFrame, order: Sequence[Column], run: Callable, added: dict[str, str], name: str) -> DataFrame:
    """A table of rows dealt out by ranges of order and sorted, with the columns that run(part, batches) adds, and __part, which grows along order."""

    def own(batches):
        return run(TaskContext.get().partitionId(), (b for b in batches if b.num_rows))

    fields = [T.StructField(n, T._parse_datatype_string(t)) for n, t in (added | {"__part": "int"}).items()]
    return table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(own, T.StructType([*rows.schema.fields, *fields])), name)


def _with(batch: pa.RecordBatch, more: dict[str, np.ndarray], part: int) -> pa.RecordBatch:
    columns = [pa.array(x.data, mask=np.ma.getmaskarray(x)) if isinstance(x, np.ma.MaskedArray) else pa.array(x) for x in more.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, *more, "__part"])


def numbered(rows: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """rows with their place from 0 in order. Rows are numbered where range partitioning puts them; what all partitions before hold is one row for each."""

    def run(part, batches):
        n = 0
        for b in batches:
            yield _with(b, {into: np.arange(n, n + b.num_rows)}, part)
            n += b.num_rows

    local = _placed(rows, order, run, {into: "long"}, "numbered")
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(sizes), "__part").withColumn(into, F.col(into) + F.col("__before")).select(*rows.columns, into)


def lagged(rows: DataFrame, key: str, at: str, into: str) -> DataFrame:
    """rows with the value of the long column `at` in the row before of the same key (a long), in ascending order of it; null for a key's first. Keys of any size are spread."""
    where = [rows.columns.index(c) for c in (key, at)]

    def run(part, batches):
        last = None
        for b in batches:
            k, x = (b.column(i).to_numpy() for i in where)
            before = np.concatenate([[last[1] if last else 0], x[:-1]])
            other = np.concatenate([[last is None or last[0] != k[0]], k[1:] != k[:-1]])
            last = k[-1], x[-1]
            yield _with(b, {into: np.ma.array(before, mask=other)}, part)

    local = _placed(rows, [F.col(key), F.col(at)], run, {into: "long"}, "lagged")
    ends = local.groupBy("__part").agg(F.max_by(F.struct(key, at), F.struct(key, at)).alias("e"), F.min(F.struct(key, at)).alias("s"))
    w = Window.orderBy("__part")
    past = ends.select("s.*", F.lag("e").over(w).alias("e")).where(F.col(f"e.{key}") == F.col(f"s.{key}")).select(key, at, F.col(f"e.{at}").alias("__past"))
    return local.join(F.broadcast(past), [key, at], "left").select(*rows.columns, F.coalesce(into, "__past").alias(into))


def carried(rows: DataFrame, order: Sequence[Column], value: str, into: str, largest: bool = False) -> DataFrame:
    """rows with the last non-null value of a long column up to each row in order, or the largest; null before the first. The smallest long counts as null."""
    where = rows.columns.index(value)

    nothing = np.iinfo(np.int64).min

    def run(part, batches):
        last, n = nothing, 0
        for b in batches:
            x = b.column(where).fill_null(nothing).to_numpy()
            x = np.concatenate([[last], x])
            if largest:
                x = np.maximum.accumulate(x)
            else:
                x = x[np.maximum.accumulate(np.where(x == nothing, 0, np.arange(len(x))))]
            x, last = x[1:], x[-1]
            yield _with(b, {into: np.ma.array(x, mask=x == nothing), "__i": np.arange(n, n + b.num_rows)}, part)
            n += b.num_rows

    local = _placed(rows, order, run, {into: "long", "__i": "long"}, "carried")
    ends = local.groupBy("__part").agg(F.max_by(into, "__i").alias("e"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    past = ends.select("__part", (F.max("e") if largest else F.last("e", ignorenulls=True)).over(before).alias("__past"))
    now = F.greatest(into, "__past") if largest else F.coalesce(into, "__past")
    return local.join(F.broadcast(past), "__part").select(*rows.columns, now.alias(into))


#: Pieces that a block of time is cut into at each level of dominance().
FAN = 1024


def dominance(points: DataFrame, into: str) -> DataFrame:
    """points (x, y) with how many points lie before and above each: smaller x, larger y. x are different whole numbers from 0, y different ones as well.

    Divide and conquer over x: at each level a block is cut into FAN pieces and gone through by falling y, and every point counts what came before it in
    earlier pieces of its block. So each level is one sort and a fold whose state is FAN numbers; the levels are log(n) to the base FAN, and
    blocks of any size are spread over partitions, whose counts by piece are added up apart.
    """
    most = points.agg(F.max("x")).first()[0]
    points, size = points.withColumn(into, F.lit(0).cast("long")), 1
    while size <= (most or 0):
        points, size = _level(points, into, size), size * FAN
    return points


def _level(points: DataFrame, into: str, size: int) -> DataFrame:
    names, fan = points.columns, FAN
    rows = points.withColumn("__block", F.expr(f"x div {size * fan}")).withColumn("__piece", F.expr(f"x div {size} % {fan}").cast("int")).withColumn("__down", -F.col("y"))
    at = [rows.columns.index(c) for c in ("__block", "__piece")]

    def run(part, batches):
        now, seen = None, np.zeros(fan, np.int64)
        for b in batches:
            block, piece = (b.column(i).to_numpy() for i in at)
            found = np.zeros(b.num_rows, np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for i, j in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if block[i] != now:
                    now, seen = block[i], np.zeros(fan, np.int64)
                p = piece[i:j]
                found[i:j] = (np.cumsum(seen) - seen)[p] + _smaller_before(p, fan)
                seen = seen + np.bincount(p, minlength=fan)
            yield _with(b, {"__found": found}, part)

    local = _placed(rows, [F.col("__block"), F.col("__down")], run, {"__found": "long"}, "dominance")
    spread = local.groupBy("__block").agg(F.min("__part").alias("a"), F.max("__part").alias("z")).where("a < z").select("__block")  # at most one for each partition
    counts = local.join(F.broadcast(spread), "__block", "left_semi").groupBy("__block", "__part", "__piece").agg(F.count("*").alias("n"))
    parts = counts.select("__block", "__part").distinct()
    # For each block over several partitions: what earlier partitions (larger y) hold of earlier pieces. FAN rows for each partition at most.
    grid = parts.select("__block", "__part", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("__piece")).join(counts, ["__block", "__part", "__piece"], "left")
    past = Window.partitionBy("__block", "__piece").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("__block", "__part").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("m", F.coalesce(F.sum("n").over(past), F.lit(0))).select("__block", "__part", "__piece", F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("__more"))
    out = local.join(grid.where("__more > 0"), ["__block", "__part", "__piece"], "left")
    return out.select(*[c for c in names if c != into], (F.col(into) + F.col("__found") + F.coalesce("__more", F.lit(0))).alias(into))


def _smaller_before(p: np.ndarray, fan: int) -> np.ndarray:
    """For each value how many smaller ones stand before it: bit by bit, those that agree above a bit, have 0 there, and meet one with 1."""
    out = np.zeros(len(p), np.int64)
    for bit in range((fan - 1).bit_length()):
        order = np.argsort(p >> (bit + 1), kind="stable")
        one = (p[order] >> bit) & 1
        zeros = np.cumsum(1 - one)
        above = p[order] >> (bit + 1)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        base = np.repeat(zeros[starts] - (1 - one[starts]), np.diff(np.append(starts, len(p))))
        out[order] += np.where(one == 1, zeros - base, 0)
    return out


def ranked(rows: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """rows numbered from 1 by order."""
    return numbered(rows, order, into).withColumn(into, (F.col(into) + 1).cast("int"))
