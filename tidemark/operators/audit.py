"""The audit log: hash chains, receipts, recent rows, session summaries and reports.

Order is by rowid within a log, never by the time an agent tells. Chains are verified by lag: a bad row still hands its stored
hash on, so every row can be checked alone. Windows run by log_id, so that many logs spread over the cluster.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.scale import in_order

SEPARATOR = "\x1f"
#: The previous hash of the first row of a chain.
GENESIS = "0" * 64
FIELDS = ("id", "timestamp_ms", "platform", "event_type", "source_app", "agent_session_id", "rule_id", "severity", "action", "human_message", "evidence_ref", "event_json")
AUDIT = T.StructType(
    [T.StructField(n, T.LongType() if n in ("rowid", "timestamp_ms", "seq") else T.StringType()) for n in ("log_id", "rowid", *FIELDS, "user_decision", "attributed_agent", "prev_hash", "record_hash", "record_sig", "signer_key_id", "seq")]
)


def canonical_content() -> Column:
    """The chained fields joined by U+001F, null as empty, and the attributed agent if there is one."""
    body = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS])
    return F.concat(body, F.coalesce(F.concat(F.lit(f"{SEPARATOR}agent="), F.col("attributed_agent")), F.lit("")))


def chain_hash(previous: Column, content: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("\n"), content), 256)


def receipt_hash(previous: Column, audit_id: Column, decision: Column, decided_at_ms: Column) -> Column:
    return F.sha2(F.concat_ws("\n", previous, audit_id, decision, decided_at_ms.cast("string")), 256)


class _Chain:
    def __init__(self):
        self.last = None

    def step(self, content, head):
        before = self.last or head or GENESIS
        self.last = hashlib.sha256(f"{before}\n{content}".encode()).hexdigest()
        return before, self.last


def chain(rows: DataFrame, content: Column, key: str = "log_id", order: str = "rowid", head: str | None = None) -> DataFrame:
    """rows with prev_hash and record_hash of each log's chain, which goes on from the column head if it is named. Each hash needs the one before, so every log is folded
    in order with one hash as state, and logs spread over the cluster."""
    plain = rows.drop("prev_hash", "record_hash").withColumn("__content", content).withColumn("__from", F.col(head) if head else F.lit(None).cast("string"))
    return in_order(plain, [key], [order], ["__content", "__from"], _Chain, {"prev_hash": "string", "record_hash": "string"}).drop("__content", "__from")


def verified(rows: DataFrame, content: Column, key: str = "log_id", order: str = "rowid", hashed: str = "record_hash") -> DataFrame:
    """rows with ok: the stored previous hash is the row before's, and the stored hash is right."""
    before = F.lag(hashed, 1, GENESIS).over(Window.partitionBy(key).orderBy(order))
    ok = (F.col("prev_hash") == before) & (F.col(hashed) == chain_hash(F.col("prev_hash"), content))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def verify_chain(rows: DataFrame, content: Column | None = None, key: str = "log_id", order: str = "rowid", id_col: str = "id") -> DataFrame:
    """One row a log: ok, total, verified, first_mismatch_id."""
    checked = verified(rows, canonical_content() if content is None else content, key, order)
    bad = F.when(~F.col("ok"), F.col(order))
    out = checked.groupBy(key).agg(F.count("*").alias("total"), F.count_if("ok").alias("verified"), F.min_by(id_col, bad).alias("first_mismatch_id"))
    return out.select(key, (F.col("total") == F.col("verified")).alias("ok"), "total", "verified", "first_mismatch_id")


def verify_receipts(receipts: DataFrame, key: str = "log_id", order: str = "seq") -> DataFrame:
    before = F.lag("receipt_hash", 1, GENESIS).over(Window.partitionBy(key).orderBy(order))
    right = receipt_hash(F.col("prev_hash"), F.col("audit_id"), F.col("decision"), F.col("decided_at_ms"))
    return receipts.withColumn("ok", F.coalesce((F.col("prev_hash") == before) & (F.col("receipt_hash") == right), F.lit(False)))


def head(rows: DataFrame, key: str = "log_id", order: str = "rowid") -> DataFrame:
    """One row a log: its newest position and hash, and how many rows it has."""
    return rows.groupBy(key).agg(F.max(order).alias("position"), F.max_by("record_hash", order).alias("record_hash"), F.count("*").alias("count"))


def check_against(current: DataFrame, witness: DataFrame, key: str = "log_id") -> DataFrame:
    """State of each log of which a head was seen earlier, the first that applies: 'missing', 'rolled_back', 'forked', and where both have receipt_count and
    receipt_hash 'receipts_deleted' and 'receipt_replaced'; else 'ok'."""
    c, w = current.alias("c"), witness.alias("w")
    at = lambda n: (F.col(f"c.{n}"), F.col(f"w.{n}"))
    (cp, wp), (cn, wn), (ch, wh) = at("position"), at("count"), at("record_hash")
    state = F.when(cp.isNull(), "missing").when((cp < wp) | (cn < wn), "rolled_back").when((cp == wp) & (cn == wn) & (ch != wh), "forked")
    if "receipt_count" in current.columns and "receipt_count" in witness.columns:
        (cr, wr), (cx, wx) = at("receipt_count"), at("receipt_hash")
        state = state.when(cr < wr, "receipts_deleted").when((cr == wr) & (wx != "") & (cx != wx), "receipt_replaced")
    return w.join(c, F.col(f"w.{key}") == F.col(f"c.{key}"), "left").select(F.col(f"w.{key}").alias(key), state.otherwise("ok").alias("state"))


def check_inclusion(rows: DataFrame, witness: DataFrame, key: str = "log_id") -> DataFrame:
    """witness (log_id, record_hash) with included: its hash is still some row's on the chain. An empty hash always is."""
    held = rows.select(key, F.col("record_hash")).distinct().withColumn("__there", F.lit(True))
    return witness.join(held, [key, "record_hash"], "left").withColumn("included", F.col("__there").isNotNull() | (F.col("record_hash") == "")).drop("__there")


def signing_message(domain: str, *fields: Column) -> Column:
    """The bytes that a signature is over: the domain and each field with its length before it, so no field can reach into the next one."""
    framed = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in (F.lit(domain), *fields)]
    return F.encode(F.concat(*framed), "UTF-8")


def recent(rows: DataFrame, n: int, order: str = "rowid") -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def export(rows: DataFrame, n: int, order: str = "rowid") -> DataFrame:
    """The last n rows in ascending order, each as a line of JSON in the column value."""
    return recent(rows, n, order).orderBy(order).select(F.to_json(F.struct("*")).alias("value"))


def started_without_result(rows: DataFrame, started: str, finished: str) -> DataFrame:
    """Rows of event type started without one of type finished whose id is theirs and '/result'."""
    done = rows.where(F.col("event_type") == finished).select(F.col("id").alias("__done"))
    return rows.where(F.col("event_type") == started).join(done, F.concat("id", F.lit("/result")) == F.col("__done"), "left_anti")


def with_receipts(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """rows with user_decision from the latest receipt of each."""
    last = receipts.groupBy(F.col("audit_id").alias("id")).agg(F.max_by("decision", "seq").alias("user_decision"))
    return rows.drop("user_decision").join(last, "id", "left")


def confirm_stats(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """approve, deny, timeout by the last verified receipt of each row; blocks and alerts without one are pending."""
    good = verify_receipts(receipts).where("ok")
    d = with_receipts(rows, good)
    actionable = F.col("action").isin("Block", "Alert")
    return d.agg(*[F.count_if(F.col("user_decision") == k).alias(k) for k in ("approve", "deny", "timeout")], F.count_if(F.col("user_decision").isNull() & actionable).alias("pending"))


def session_summary(rows: DataFrame, session: str = "agent_session_id") -> DataFrame:
    """Events, blocks and alerts of each session, counted from the rows."""
    a = F.lower("action")
    return rows.groupBy(session).agg(F.count("*").alias("event_count"), F.count_if(a.contains("block")).alias("block_count"), F.count_if(a.contains("alert")).alias("alert_count"), F.min("timestamp_ms").alias("started_at"), F.max("timestamp_ms").alias("ended_at"))


def report_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by class of action and by outcome of confirmation, overall or by columns."""
    a = F.lower("action")
    block, alert = a.contains("block"), a.contains("alert")
    kind = F.when(block, "block").when(alert, "alert").when(a.contains("allow"), "allow").otherwise("log_only")
    rows = rows.withColumn("__k", kind)
    d = F.col("user_decision")
    return rows.groupBy(*by).agg(
        F.count("*").alias("record_count"),
        *[F.count_if(F.col("__k") == k).alias(f"{k}_count") for k in ("block", "alert", "allow", "log_only")],
        *[F.count_if(d == k).alias(k) for k in ("approve", "deny", "timeout")],
        F.count_if(d.isNull() & (F.col("action").contains("Block") | F.col("action").contains("Alert"))).alias("pending"),
    )


def top_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value of a column, most first, equal ones by value."""
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(column))


def top_messages(rows: DataFrame, n: int = 8, order: str = "rowid") -> DataFrame:
    """'[rule] message' of the first n blocks and alerts."""
    a = F.lower("action")
    return rows.where(a.contains("block") | a.contains("alert")).orderBy(order).limit(n).select(order, F.concat(F.lit("["), F.col("rule_id"), F.lit("] "), F.col("human_message")).alias("message"))


def report_rows(rows: DataFrame) -> DataFrame:
    """(part, name, count): the whole report's counts by 'rule' and 'source_app' as rows, however many there are."""
    counts = lambda part, c: rows.groupBy(F.lit(part).alias("part"), F.col(c).alias("name")).agg(F.count("*").alias("count"))
    return counts("rule", "rule_id").unionByName(counts("source_app", "source_app"))


#: Rules or apps beyond which a report is no document any more.
MOST_LISTED = 10_000


def report(rows: DataFrame) -> dict:
    """The session report as one dictionary: counts, all rules and apps, and first messages. Beyond MOST_LISTED rules or apps it raises; report_rows() has them as rows then."""
    out = report_counts(rows).first().asDict()
    for name, column in (("by_rule", "rule_id"), ("by_source_app", "source_app")):
        found = top_counts(rows, column).limit(MOST_LISTED + 1).collect()
        if len(found) > MOST_LISTED:
            raise ValueError(f"more than {MOST_LISTED} values of {column}: write report_rows() instead")
        out[name] = [r.asDict() for r in found]
    out["top_messages"] = [r["message"] for r in top_messages(rows).collect()]
    return out


def render_markdown(report: dict, title: str = "Session report") -> str:
    lines = [f"# {title}", "", f"{report['record_count']} records: {report['block_count']} blocked, {report['alert_count']} alerts, {report['allow_count']} allowed, {report['log_only_count']} logged.", "", "| rule | count |", "|---|---|"]
    lines += [f"| {r['rule_id']} | {r['count']} |" for r in report["by_rule"]]
    return "\n".join([*lines, "", *[f"- {m}" for m in report["top_messages"]], ""])


def append(rows: DataFrame, path: str, batch: int, content: Column | None = None, order: str = "rowid") -> None:
    """Appends batch number `batch` of rows to the log at path: numbered (seq) and chained (prev_hash, record_hash) on from each log's head.

    Rows lie below path/rows/batch=N and the heads of all logs after batch N below path/heads/batch=N. A batch only reads the heads of the one before it and
    overwrites its own folders, so a batch that is run again, after a failure at any point, changes nothing. Batches come in order.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "log_id string, seq long, record_hash string")
    old = spark.read.schema(empty.schema).parquet(f"{path}/heads/batch={batch - 1}") if batch > 0 else empty
    content = canonical_content() if content is None else content
    new = next_sequence(old, rows.drop("seq"), order)
    new = chain(new.join(old.select("log_id", F.col("record_hash").alias("__head")), "log_id", "left"), content, order="seq", head="__head").drop("__head")
    at = f"{path}/rows/batch={batch}"
    new.write.mode("overwrite").parquet(at)
    now = spark.read.schema(new.schema).parquet(at).groupBy("log_id").agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("record_hash"))
    kept = old.join(now.select("log_id"), "log_id", "left_anti").unionByName(now)
    kept.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")


def append_stream(stream: DataFrame, path: str, checkpoint: str, content: Column | None = None, order: str = "rowid"):
    """A streaming query that appends every micro-batch by append(): what is replayed after a failure is written once."""
    return stream.writeStream.foreachBatch(lambda rows, n: append(rows, path, n, content, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new instead of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def next_sequence(rows: DataFrame, new: DataFrame, order: str, column: str = "seq", key: str = "log_id") -> DataFrame:
    """new numbered on from each log's greatest number."""
    last = rows.groupBy(key).agg(F.max(column).alias("__last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(last, key, "left").withColumn(column, (F.coalesce("__last", F.lit(0)) + n).cast("long")).drop("__last")


def of_type(rows: DataFrame, event_type: str, n: int, order: str = "rowid") -> DataFrame:
    """The first n rows of an event type."""
    return rows.where(F.col("event_type") == event_type).orderBy(order).limit(n)


def around_hash(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose own or previous hash is one of hashes (record_hash): two equal joins instead of one on either column."""
    wanted = hashes.select(F.col("record_hash").alias("__h")).distinct()
    own = rows.join(wanted, F.col("record_hash") == F.col("__h"), "left_semi")
    return own.unionByName(rows.join(wanted, (F.col("prev_hash") == F.col("__h")) & ~F.col("record_hash").eqNullSafe(F.col("__h")), "left_semi")).distinct()


def preferred(rows: DataFrame, by: str, wanted: Column, order: str) -> DataFrame:
    """One row for each value of by: one for which wanted holds if there is any, else the first by order."""
    return rows.groupBy(by).agg(F.min_by(F.struct("*"), F.struct(F.when(wanted, 0).otherwise(1), F.col(order))).alias("r")).select("r.*")


def reassembled(chunks: DataFrame, file: str = "file_index", order: str = "chunk_index", data: str = "data") -> DataFrame:
    """(file, text, chunks) out of chunks put together in order; a file's chunks have to fit a row, as the file does."""
    got = chunks.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(data).alias("d")))).alias("c"))
    return got.select(file, F.array_join(F.transform("c", lambda x: x["d"]), "").alias("text"), F.size("c").alias("chunks"))


def history(rows: DataFrame, key: str, version: str) -> DataFrame:
    """rows of each key in order of version: step from 1, and latest on the last one."""
    by = Window.partitionBy(key).orderBy(version)
    return rows.withColumn("step", F.row_number().over(by)).withColumn("latest", F.lead(version).over(by).isNull())


def status(rows: DataFrame) -> DataFrame:
    """The log's state in one row: records, sessions, the newest row and its time, what was blocked, and what still waits for an answer."""
    waiting = F.col("user_decision").isNull() & F.col("action").isin("Block", "Alert")
    return rows.agg(F.count("*").alias("records"), F.countDistinct("agent_session_id").alias("sessions"), F.max("rowid").alias("last_rowid"), F.max_by("timestamp_ms", "rowid").alias("last_ms"), F.count_if(F.col("action") == "Block").alias("blocked"), F.count_if(waiting).alias("waiting"))
