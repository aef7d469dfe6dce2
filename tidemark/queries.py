"""Registered queries over the parquet tables, each with DuckDB SQL for the same rows where SQL can express it.

The tables have no audit log, so one is laid over events: a log and a session for each user, rows ordered by event_id, and an action by event type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import entities, fields, hosts, paths, text
from tidemark.operators import audit, browser, evals, frames, joins, registry, rules, scores, sessions, taint, trajectory

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows  # stored without a zone: UTC


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as audit rows."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "Block").when(kind == "purchase", "Alert").when(kind == "signup", "LogOnly").otherwise("Allow")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("rowid"), F.col("event_id").cast("string").alias("id"), F.unix_millis("ts").alias("timestamp_ms"), F.lit("browser").alias("platform"), "event_type",
        F.concat(F.lit("app"), (F.col("event_id") % 7).cast("string")).alias("source_app"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("agent_session_id"), F.upper(kind).alias("rule_id"), F.when(kind == "error", "High").otherwise("Info").alias("severity"),
        action.alias("action"), F.concat(F.lit("saw "), kind).alias("human_message"), F.lit(None).cast("string").alias("evidence_ref"), F.col("props").alias("event_json"),
        F.when(kind == "error", F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, "deny")).alias("user_decision"), F.lit(None).cast("string").alias("attributed_agent"),
    )


AUDIT_SQL = """audit AS (SELECT CAST(user_id AS VARCHAR) AS log_id, event_id AS rowid_, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS timestamp_ms, event_type,
 'app' || CAST(event_id % 7 AS VARCHAR) AS source_app, 's' || CAST(user_id AS VARCHAR) AS agent_session_id, upper(event_type) AS rule_id,
 CASE WHEN event_type = 'error' THEN 'High' ELSE 'Info' END AS severity,
 CASE event_type WHEN 'error' THEN 'Block' WHEN 'purchase' THEN 'Alert' WHEN 'signup' THEN 'LogOnly' ELSE 'Allow' END AS action,
 'saw ' || event_type AS human_message, props AS event_json,
 CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'deny' END END AS user_decision FROM events)"""


# ---- audit log ----


@query(f"""WITH {AUDIT_SQL} SELECT count(*) AS record_count, count(*) FILTER (action = 'Block') AS block_count, count(*) FILTER (action = 'Alert') AS alert_count,
 count(*) FILTER (action = 'Allow') AS allow_count, count(*) FILTER (action = 'LogOnly') AS log_only_count, count(*) FILTER (user_decision = 'approve') AS approve,
 count(*) FILTER (user_decision = 'deny') AS deny, count(*) FILTER (user_decision = 'timeout') AS timeout, count(*) FILTER (user_decision IS NULL AND action IN ('Block', 'Alert')) AS pending FROM audit""")
def a1_session_report(spark, sf_dir):
    return audit.report_counts(audit_rows(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT 'rule' AS kind, rule_id AS name, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'app', source_app, count(*) FROM audit GROUP BY 2")
def a1_top_rules_and_apps(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    one = lambda kind, c: audit.top_counts(rows, c).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), F.col("count").alias("n"))
    return one("rule", "rule_id").unionByName(one("app", "source_app"))


@query(f"WITH {AUDIT_SQL} SELECT rowid_ AS rowid, '[' || rule_id || '] ' || human_message AS message FROM audit WHERE action IN ('Block', 'Alert') ORDER BY rowid_ LIMIT 8")
def a1_top_messages(spark, sf_dir):
    return audit.top_messages(audit_rows(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT agent_session_id, count(*) AS event_count, count(*) FILTER (action = 'Block') AS block_count, count(*) FILTER (action = 'Alert') AS alert_count, min(timestamp_ms) AS started_at, max(timestamp_ms) AS ended_at FROM audit GROUP BY 1")
def w8_session_summary(spark, sf_dir):
    return audit.session_summary(audit_rows(spark, sf_dir))


CHAIN_SQL = f"""WITH RECURSIVE {AUDIT_SQL}, c AS (SELECT log_id, rowid_, row_number() OVER (PARTITION BY log_id ORDER BY rowid_) AS i,
 concat_ws(chr(31), id, CAST(timestamp_ms AS VARCHAR), 'browser', event_type, source_app, agent_session_id, rule_id, severity, action, human_message, '', event_json) AS content FROM audit),
 h AS (SELECT log_id, rowid_, i, content, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || chr(10) || content) AS record_hash FROM c WHERE i = 1
 UNION ALL SELECT c.log_id, c.rowid_, c.i, c.content, h.record_hash, sha256(h.record_hash || chr(10) || c.content) FROM h JOIN c ON c.log_id = h.log_id AND c.i = h.i + 1)"""


@query(CHAIN_SQL + " SELECT log_id, rowid_ AS rowid, prev_hash, record_hash FROM h")
def w3_chain_hashes(spark, sf_dir):
    return audit.chain(audit_rows(spark, sf_dir), audit.canonical_content()).select("log_id", "rowid", "prev_hash", "record_hash")


@query(CHAIN_SQL + """, t AS (SELECT log_id, rowid_, CASE WHEN rowid_ % 50 = 7 THEN content || '!' ELSE content END AS content, prev_hash, record_hash FROM h),
 v AS (SELECT *, prev_hash = lag(record_hash, 1, repeat('0', 64)) OVER (PARTITION BY log_id ORDER BY rowid_) AND record_hash = sha256(prev_hash || chr(10) || content) AS ok FROM t)
 SELECT log_id, bool_and(ok) AS ok, count(*) AS total, count(*) FILTER (ok) AS verified, CAST(min(rowid_) FILTER (NOT ok) AS VARCHAR) AS first_mismatch_id FROM v GROUP BY 1""")
def w1_verify_chain(spark, sf_dir):
    rows = audit.chain(audit_rows(spark, sf_dir), audit.canonical_content())
    altered = rows.withColumn("event_json", F.when(F.col("rowid") % 50 == 7, F.concat("event_json", F.lit("!"))).otherwise(F.col("event_json")))
    return audit.verify_chain(altered)


@query(f"WITH {AUDIT_SQL} SELECT log_id, max(rowid_) AS position, arg_max(sha256(id), rowid_) AS record_hash, count(*) AS n FROM audit GROUP BY 1")
def w7_head(spark, sf_dir):
    return audit.head(audit_rows(spark, sf_dir).withColumn("record_hash", F.sha2("id", 256))).withColumnRenamed("count", "n")


@query(f"WITH {AUDIT_SQL} SELECT rowid_ AS rowid, id, action FROM audit ORDER BY rowid_ DESC LIMIT 20")
def q8_recent(spark, sf_dir):
    return audit.recent(audit_rows(spark, sf_dir), 20).select("rowid", "id", "action")


@query(f"""WITH {AUDIT_SQL}, r AS (SELECT id, event_type FROM audit WHERE event_type = 'click' UNION ALL SELECT CAST(rowid_ - 1 AS VARCHAR) || '/result', 'view' FROM audit WHERE event_type = 'view')
 SELECT s.id FROM r s WHERE s.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM r f WHERE f.event_type = 'view' AND f.id = s.id || '/result')""")
def q9_started_without_result(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).select("rowid", "id", "event_type")
    both = rows.where("event_type = 'click'").unionByName(rows.where("event_type = 'view'").withColumn("id", F.concat((F.col("rowid") - 1).cast("string"), F.lit("/result"))))
    return audit.started_without_result(both, "click", "view").select("id")


@query(f"WITH {AUDIT_SQL} SELECT agent_session_id, action, count(*) AS n, coalesce(sum(length(event_json)), 0)::BIGINT AS bytes, max(rowid_) + 1 AS next_seq FROM audit WHERE action ILIKE '%block%' OR action ILIKE '%alert%' GROUP BY 1, 2 HAVING count(*) > 1")
def q_statements(spark, sf_dir):
    """Counts, sums with a default, maximum plus one, LIKE filters and HAVING of the log's statements in one."""
    rows = audit_rows(spark, sf_dir).where(F.col("action").ilike("%block%") | F.col("action").ilike("%alert%"))
    return rows.groupBy("agent_session_id", "action").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("event_json")), F.lit(0)).alias("bytes"), (F.max("rowid") + 1).alias("next_seq")).where("n > 1")


@query(f"""WITH {AUDIT_SQL}, r AS (SELECT id AS audit_id, rowid_ AS seq, CASE rowid_ % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'deny' ELSE 'timeout' END AS decision FROM audit WHERE action = 'Block' AND rowid_ % 5 <> 0)
 SELECT count(*) FILTER (decision = 'approve') AS approve, count(*) FILTER (decision = 'deny') AS deny, count(*) FILTER (decision = 'timeout') AS timeout,
 count(*) FILTER (decision IS NULL AND action IN ('Block', 'Alert')) AS pending FROM audit LEFT JOIN r ON audit_id = id""")
def w9_confirm_stats(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    r = rows.where("action = 'Block' and rowid % 5 <> 0").select("log_id", F.col("id").alias("audit_id"), F.col("rowid").alias("seq"), F.when(F.col("rowid") % 4 == 0, "approve").when(F.col("rowid") % 4 == 1, "deny").otherwise("timeout").alias("decision"), F.col("timestamp_ms").alias("decided_at_ms"))
    content = F.concat_ws("\n", "audit_id", "decision", F.col("decided_at_ms").cast("string"))
    chained = audit.chain(r, content, order="seq").withColumnRenamed("record_hash", "receipt_hash")
    return audit.confirm_stats(rows, chained)


# ---- trajectories ----

PLAN = trajectory.Plan(allow=("view", "click", "purchase", "signup"), most={"purchase": 2}, order=("view", "click", "purchase"), terminal="signup")
DRIFT_SQL = f"""WITH {AUDIT_SQL}, s AS (SELECT log_id, rowid_, event_type AS k, action <> 'Block' AS ran,
 count(*) FILTER (event_type = 'purchase' AND action <> 'Block') OVER w AS p, count(*) FILTER (event_type = 'view' AND action <> 'Block') OVER w AS v,
 count(*) FILTER (event_type = 'click' AND action <> 'Block') OVER w AS c, count(*) FILTER (event_type = 'signup' AND action <> 'Block') OVER w AS t FROM audit
 WINDOW w AS (PARTITION BY log_id ORDER BY rowid_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, CASE WHEN k = 'error' THEN 'out_of_plan' WHEN k = 'purchase' AND p >= 2 THEN 'over_budget' WHEN (k = 'click' AND v = 0) OR (k = 'purchase' AND (v = 0 OR c = 0)) THEN 'out_of_order' WHEN t > 0 THEN 'after_terminal' END AS own FROM s),
 d AS (SELECT log_id, rowid_, CASE WHEN coalesce(bool_or(own IS NOT NULL) OVER (PARTITION BY log_id ORDER BY rowid_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'unanchored' ELSE own END AS drift FROM o)"""


def _judged(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).withColumn("ran", F.col("action") != "Block")
    return trajectory.judge(rows, PLAN, session="log_id", kind="event_type", executed="ran", observations=())


@query(DRIFT_SQL + " SELECT log_id, rowid_ AS rowid, drift FROM d")
def w10_plan_drift(spark, sf_dir):
    return _judged(spark, sf_dir).select("log_id", "rowid", "drift")


@query(DRIFT_SQL + " SELECT log_id, count(*) AS judged, count(drift) AS drifted, round(count(drift)::DOUBLE / count(*), 9) AS drift_score FROM d GROUP BY 1")
def a18_drift_score(spark, sf_dir):
    return trajectory.drift_score(_judged(spark, sf_dir), session="log_id", kind="event_type", observations=()).withColumn("drift_score", F.round("drift_score", 9))


@query(f"""WITH {AUDIT_SQL}, f AS (SELECT log_id, rowid_, event_type, source_app, last_value(CASE WHEN event_type = 'view' THEN source_app END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY rowid_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS focused_app FROM audit)
 SELECT log_id, rowid_ AS rowid, focused_app, coalesce(event_type <> 'view' AND source_app <> focused_app, false) AS transition FROM f""")
def f46_transition_guard(spark, sf_dir):
    return trajectory.transitions(audit_rows(spark, sf_dir), session="log_id", focus=F.col("event_type") == "view").select("log_id", "rowid", "focused_app", "transition")


# ---- sessions ----


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def x3_once_per_session(spark, sf_dir):
    return sessions.once_per_session(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 40 AS nonce, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 q AS (SELECT user_id, event_id, i, [nonce] AS q, false AS replay FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN list_contains(q, nonce) THEN q ELSE list_append(q, nonce)[-16:] END, list_contains(q, nonce) FROM q JOIN n ON n.user_id = q.user_id AND n.i = q.i + 1)
 SELECT user_id, event_id, replay FROM q""")
def x5_replays(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 40).alias("nonce"))
    return sessions.replays(rows, "user_id", "nonce", "event_id", window=16).select("user_id", "event_id", "replay")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
 f AS (SELECT user_id, event_type, event_id, i, t AS anchor, true AS emit, 0 AS repeats FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN e.t - anchor >= 86400000 THEN e.t ELSE anchor END, e.t - anchor >= 86400000, CASE WHEN emit THEN CASE WHEN e.t - anchor >= 86400000 THEN 0 ELSE 1 END ELSE CASE WHEN e.t - anchor >= 86400000 THEN repeats ELSE repeats + 1 END END
 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1) SELECT event_id, emit, repeats FROM f""")
def x8_throttle(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis("ts").alias("timestamp_ms"), F.col("event_id").alias("rowid"))
    return sessions.throttle(rows, ["user_id", "event_type"], window_ms=86_400_000).select(F.col("rowid").alias("event_id"), "emit", "repeats")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS total FROM s GROUP BY user_id, k""")
def x9_bursts(spark, sf_dir):
    out = sessions.bursts(read(spark, sf_dir, "events"), ["user_id"], gap="6 hours")
    return out.select("user_id", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "total")


@query("""WITH f AS (SELECT user_id, event_id, event_type, 'app' || CAST(event_id % 3 AS VARCHAR) AS app, event_type IN ('purchase', 'signup') AS high FROM events)
 SELECT a.user_id, a.event_id, a.high AND EXISTS (SELECT 1 FROM f b WHERE b.high AND b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id < a.event_id AND b.app <> a.app) AS crossed FROM f a""")
def x14_cross_app(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("rowid"), F.col("event_type").alias("profile_key"), F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")).alias("source_app"), F.lit(True).alias("value_filled"))
    rows = rows.withColumn("tier", F.when(F.col("profile_key").isin("purchase", "signup"), "high").otherwise("low"))
    return sessions.cross_app(rows).select(F.col("session").alias("user_id"), F.col("rowid").alias("event_id"), "crossed")


@query("""WITH m AS (SELECT user_id, event_id, event_type, CAST(event_id % 6 AS VARCHAR) AS k FROM events WHERE event_type IN ('signup', 'click')),
 r AS (SELECT *, coalesce(bool_or(event_type = 'signup') OVER (PARTITION BY user_id, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS saved FROM m)
 SELECT user_id, event_id, CASE WHEN NOT saved THEN 'PRIV-MEM-READ' WHEN k = '5' THEN 'PRIV-MEM-USE' ELSE 'ALLOW' END AS rule_id, saved AND k <> '5' AS correct FROM r WHERE event_type = 'click'""")
def x16_memory_reads(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click"))
    key = (F.col("event_id") % 6).cast("string")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("rowid"), key.alias("item_key"), F.when(key == "5", "4").otherwise(key).alias("expected_key"), F.when(F.col("event_type") == "signup", "save").otherwise("read").alias("op"), F.lit(True).alias("approved"))
    return sessions.memory_reads(rows).select(F.col("session").alias("user_id"), F.col("rowid").alias("event_id"), "rule_id", "correct")


@query("SELECT user_id AS item_key, max(event_id) AS version, arg_max(event_type, event_id) AS state FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def w15_current_memory(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("item_key"), F.col("event_id").alias("version"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "error", "revoked").otherwise("active").alias("state"), F.lit(None).cast("long").alias("expires_ms"))
    return sessions.current_memory(rows, 0).select("item_key", "version", F.col("kind").alias("state"))


@query("""WITH w AS (SELECT user_id AS license_id, event_id, CAST(floor(value) AS BIGINT) % 1000 AS version, event_id % 11 <> 0 AS ok FROM events),
 m AS (SELECT *, max(CASE WHEN ok THEN version END) OVER (PARTITION BY license_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w) SELECT license_id, event_id, ok AND (seen IS NULL OR version > seen) AS admitted FROM m""")
def x34_admit_webhooks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("license_id"), "event_id", F.unix_millis("ts").alias("created_ms"), (F.unix_millis("ts") + F.when(F.col("event_id") % 11 == 0, 900_000).otherwise(1_000)).alias("received_ms"), (F.floor("value") % 1000).alias("version"), F.col("event_id").alias("rowid"))
    return taint.admit_webhooks(rows).select("license_id", "event_id", "admitted")


# ---- joins ----


@query("""WITH v AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'click')
 SELECT c.user_id, c.event_id, v.t AS last_tick, coalesce(c.t - v.t <= 3600000, false) AS backed FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t""")
def j7_backed_by_tick(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_millis("ts"))
    out = joins.backed(e.where("event_type = 'click'").select("user_id", "event_id", "t"), e.where("event_type = 'view'").select("user_id", "t"), "t", 3_600_000, "user_id")
    return out.select("user_id", "event_id", "last_tick", "backed")


@query("""WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), s AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 1 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
 SELECT coalesce(b.doc_id, s.doc_id) AS path, CASE WHEN b.h IS NULL THEN 'added' WHEN s.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN s ON b.doc_id = s.doc_id WHERE b.h IS DISTINCT FROM s.h""")
def j11_diff_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("sha256"))
    new = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")).cast("binary")).alias("sha256"))
    return joins.diff_files(old, new)


@query("""WITH s AS (SELECT event_id // 3 AS a, event_id, event_id % 3 AS k FROM events), g AS (SELECT a, max(CASE WHEN k = 0 THEN event_id END) AS d, max(CASE WHEN k = 1 THEN event_id END) AS s, max(CASE WHEN k = 2 AND a % 4 <> 0 THEN event_id END) AS f FROM s GROUP BY 1),
 r AS (SELECT *, d IS NOT NULL AND a % 5 = 0 AS refuse, CASE WHEN f IS NOT NULL THEN CASE WHEN d IS NULL AND s IS NULL THEN 'terminal_without_prior' ELSE 'tool_returned_effects_unknown' END WHEN s IS NOT NULL THEN 'started_without_result' WHEN a % 5 = 0 THEN 'refused' ELSE 'decided_not_started' END AS state, NOT (s IS NOT NULL AND d IS NOT NULL AND a % 5 = 0) AS valid FROM g)
 SELECT CAST(a AS VARCHAR) AS action_id, state, valid, CASE WHEN NOT valid THEN 'unknown' WHEN state = 'refused' THEN 'blocked' WHEN state = 'tool_returned_effects_unknown' THEN 'record' ELSE 'unknown' END AS classification, greatest(coalesce(d, -1), coalesce(s, -1), coalesce(f, -1)) AS last FROM r WHERE d IS NOT NULL OR s IS NOT NULL OR f IS NOT NULL""")
def j8_execution_view(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("a", F.floor(F.col("event_id") / 3)).withColumn("k", F.col("event_id") % 3)
    rows = e.where("k <> 2 or a % 4 <> 0").select(
        F.concat(F.col("a").cast("string"), F.when(F.col("k") == 0, "/decision").when(F.col("k") == 2, "/result").otherwise("")).alias("id"), F.col("event_id").alias("rowid"),
        F.when(F.col("k") == 0, "GatewayDecision").when(F.col("k") == 1, "GatewayExecutionStarted").otherwise("GatewayExecutionFinished").alias("event_type"),
        F.when(F.col("k") == 0, F.when(F.col("a") % 5 == 0, "refuse").otherwise("execute")).when(F.col("k") == 1, "started").otherwise("success").alias("action"), (F.col("k") == 2).alias("dispatched"),
    )
    return joins.execution_view(rows)


@query("""WITH r AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 3 AS digest, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'revoked' END AS state FROM events),
 l AS (SELECT *, lag(state) OVER w AS was, lag(digest) OVER w AS wd FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, event_id, coalesce(wd <> digest, false) AS changed, CASE WHEN was IS NULL THEN state = 'pending' WHEN was = 'pending' THEN state IN ('approved', 'denied', 'pending') WHEN was = 'approved' THEN state IN ('pending', 'revoked') ELSE state = 'pending' END AS legal FROM l""")
def r31_manifest_changes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 3).alias("digest"), F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "approved").otherwise("revoked").alias("state"))
    return joins.manifest_changes(rows, "user_id", "event_id").select("user_id", "event_id", "changed", "legal")


HOST_SQL = "regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1)"


@query(f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), p AS (SELECT host, max(page_id) AS added_ms FROM h WHERE page_id % 3 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), s AS (SELECT host, max(page_id) + 100 AS expires_ms FROM h WHERE page_id % 3 = 1 GROUP BY 1)
 SELECT host, 'persistent' AS kind, CAST(NULL AS BIGINT) AS expires_ms FROM p UNION ALL SELECT host, 'session', expires_ms FROM s WHERE expires_ms > 150 AND host NOT IN (SELECT host FROM p)""")
def r10_merge_blocklist(spark, sf_dir):
    h = read(spark, sf_dir, "pages").select("page_id", hosts.url_host(F.col("url")).alias("host"))
    return joins.merge_blocklist(h.where("page_id % 3 = 0").withColumnRenamed("page_id", "added_ms"), h.where("page_id % 3 = 1").withColumnRenamed("page_id", "seen_ms"), 150, cap=50, ttl_ms=100)


# ---- hosts, rules, text ----


@query(f"""SELECT page_id, {HOST_SQL} AS url_host, split_part(split_part(regexp_replace(url, '^.*?://', ''), '/', 1), ':', 1) AS bare_host, ({HOST_SQL} = 'example.com' OR {HOST_SQL} LIKE '%.example.com') AS in_scope FROM pages""")
def f11_hosts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", hosts.url_host(u).alias("url_host"), hosts.bare_host(u).alias("bare_host"), hosts.host_in_scope(hosts.url_host(u), F.lit("example.com")).alias("in_scope"))


@query(f"""WITH d AS (SELECT DISTINCT {HOST_SQL} AS domain FROM pages WHERE page_id % 11 = 0 UNION SELECT 'example.net'), p AS (SELECT page_id, {HOST_SQL} AS host, length(html) * 1000 AS bytes_out FROM pages),
 m AS (SELECT page_id, host, bytes_out, (SELECT d.domain FROM d WHERE p.host = d.domain OR p.host LIKE '%.' || d.domain ORDER BY length(d.domain) DESC LIMIT 1) AS domain FROM p)
 SELECT page_id, domain, CASE WHEN domain IS NOT NULL THEN 'INTEL-DOMAIN' WHEN bytes_out >= 5000000 THEN 'PRIV-005' ELSE 'ALLOW' END AS rule_id,
 CASE WHEN domain IS NOT NULL THEN 'Suspicious egress host: ' || lower(host) WHEN bytes_out >= 5000000 THEN 'Large upload ' || bytes_out || ' bytes to ' || lower(host) ELSE '' END AS message FROM m""")
def f10_evaluate_flow(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", hosts.url_host(F.col("url")).alias("host"), (F.length("html") * 1000).alias("bytes_out"))
    d = p.where("page_id % 11 = 0").select(F.col("host").alias("domain")).unionByName(spark.createDataFrame([("example.net",)], "domain string"))
    rows = rules.malicious_hosts(p, F.col("host"), d, "domain")
    d = rules.evaluate_flow(F.col("domain"), F.col("host"), F.col("bytes_out"))
    return rows.select("page_id", "domain", d["rule_id"].alias("rule_id"), d["human_message"].alias("message"))


RULES = [
    {"id": "R-LICENSE", "name": "license", "severity": "low", "action": "alert", "match_any_text": ["license", "rights reserved"]},
    {"id": "R-TOKEN", "name": "token", "severity": "critical", "action": "block", "require_confirm": True, "match_any_text": ["token ="]},
    {"id": "R-SLUR", "name": "slur", "severity": "medium", "action": "alert", "match_any_text": ["idiot", "moron", "pathetic"]},
    {"id": "R-MAIL", "name": "mail", "severity": "high", "action": "block", "require_confirm": True, "match_any_text": ["@"]},
]


@query("""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents),
 m AS (SELECT doc_id, unnest([{'b': 0, 'c': 0, 'n': CASE WHEN contains(t, 'rights reserved') THEN 15 WHEN contains(t, 'license') THEN 7 END, 'p': 0, 'id': 'R-LICENSE'},
 {'b': 1, 'c': 1, 'n': CASE WHEN contains(t, 'token =') THEN 7 END, 'p': 1, 'id': 'R-TOKEN'},
 {'b': 0, 'c': 0, 'n': CASE WHEN contains(t, 'pathetic') THEN 8 WHEN contains(t, 'idiot') OR contains(t, 'moron') THEN 5 END, 'p': 2, 'id': 'R-SLUR'},
 {'b': 1, 'c': 1, 'n': CASE WHEN contains(t, '@') THEN 1 END, 'p': 3, 'id': 'R-MAIL'}]) AS r FROM t)
 SELECT doc_id, r.id AS rule_id FROM m WHERE r.n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r.b DESC, r.c DESC, r.n DESC, r.p DESC) = 1""")
def f1_most_specific_rule(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    r = rules.most_specific_rule(F.col("text"), F.lit("ui_text"), F.lit("browser"), RULES)
    return d.select("doc_id", r["rule_id"].alias("rule_id")).where("rule_id is not null")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+[.][A-Za-z]{2,24}'))) > 0 AS has_email FROM documents WHERE contains(text, '@')")
def t13_emails(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("contains(text, '@')")
    return d.select("doc_id", (F.size(entities.scan_emails(F.col("text"))) > 0).alias("has_email"))


@query("""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS c FROM documents), l AS (SELECT doc_id, c, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN CAST(substr(c, i, 1) AS INT) * 2 > 9 THEN CAST(substr(c, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(c, i, 1) AS INT) * 2 END) ELSE CAST(substr(c, i, 1) AS INT) END)) % 10 = 0 AS valid FROM d)
 SELECT doc_id, c AS digits, valid FROM l""")
def t8_luhn(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("digits"))
    return d.select("doc_id", "digits", entities.luhn(F.col("digits")).alias("valid"))


@query("""WITH w AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
 t AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS a, list_distinct(list_filter(list_transform(string_split_regex(next, '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS b FROM w WHERE next IS NOT NULL)
 SELECT conv_id, turn, CAST(len(a) AS INT) AS tree_tokens, CAST(len(b) AS INT) AS screen_tokens, CAST(len(list_intersect(a, b)) AS INT) AS shared, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS jaccard FROM t WHERE len(a) >= 4 AND len(b) >= 4""")
def t37_compare_views(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    c = c.withColumn("c", text.compare_views(F.col("text"), F.col("next"))).where("c is not null")
    return c.select("conv_id", "turn", "c.tree_tokens", "c.screen_tokens", "c.shared", F.round("c.jaccard", 9).alias("jaccard"))


@query()
def t4_entities(spark, sf_dir):
    """Entities of all documents by kind. The scanners look around matches, which DuckDB's expressions can't; tests hold them against cases."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(entities.recognise(F.col("text"))).alias("e"))
    return d.groupBy("e.kind", "e.verified").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query()
def t25_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.scan_anomalies(F.col("text"))).alias("a"))
    return d.groupBy("a.kind").agg(F.count("*").alias("docs"), F.sum("a.count").alias("n"))


@query("SELECT role, count(*) AS n, count(*) FILTER (contains(regexp_replace(lower(text), '\\s', '', 'g'), '<|') OR contains(regexp_replace(lower(text), '\\s', '', 'g'), '[inst]')) AS broken FROM conversations GROUP BY 1")
def t27_breakouts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.detect_breakout(F.col("text")).alias("breakout"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count("breakout").alias("broken"))


@query()
def t23_log_safe(spark, sf_dir):
    changed = F.filter(F.array(entities.log_safe(F.col("text"))), lambda safe: safe != F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(changed).alias("safe")).select("doc_id", F.length("safe").alias("n_chars"))  # made once, where a condition would make it again


@query("""WITH p AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), c AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS c FROM p)
 SELECT page_id, len(c) >= 2 AND c[2] = 'en' AS inside, CASE page_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'delete' WHEN 2 THEN 'write' ELSE 'delete' END AS intent FROM c""")
def f30_paths(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    first = F.get(paths.parts(F.col("path")), F.lit(0))
    verb = F.get(F.array(*map(F.lit, ("ls", "rm", "tee", "find"))), (F.col("page_id") % 4).cast("int"))
    args = F.when(F.col("page_id") % 4 == 3, F.array(F.lit("-delete"))).otherwise(F.array(F.lit("x1")))
    return p.select("page_id", paths.is_within(F.concat(F.lit("/"), first, F.lit("/en")), F.col("path")).alias("inside"), paths.infer_intent(verb, args).alias("intent"))


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'seg' ELSE 'none' END AS kind, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'high' ELSE 'low' END AS tier, (('0x' || substr(sha256(encode('tidemark.rollout.v1') || '\\x00'::BLOB || encode('[\"stable\",\"s1\",\"device-' || CAST(c_custkey AS VARCHAR) || '\"]')), 1, 8))::BIGINT % 10000) < 2500 AS selected FROM customer")
def m5_rollout_and_tiers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.when(text.any_of(F.lower("c_mktsegment"), ["auto"]), "seg").otherwise("none").alias("kind"), fields.tier(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("tier"), fields.rollout_selected(F.concat(F.lit("device-"), F.col("c_custkey").cast("string")), "stable", "s1", 2500).alias("selected"))


# ---- scores ----

NEED_SQL = "CASE event_id % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'plausible' WHEN 2 THEN 'unnecessary' ELSE 'forbidden' END"


def _necessity():
    k = F.col("event_id") % 4
    return F.when(k == 0, "required").when(k == 1, "plausible").when(k == 2, "unnecessary").otherwise("forbidden")


SCORES_SQL = f"""a AS (SELECT user_id, greatest(0, least(1, 1 - sum(CASE {NEED_SQL} WHEN 'required' THEN 0.0 WHEN 'plausible' THEN CASE WHEN value > 50 THEN 0.15 ELSE 0.0 END WHEN 'unnecessary' THEN CASE WHEN value > 50 THEN 0.35 ELSE 0.15 END ELSE CASE WHEN value > 50 THEN 0.5 ELSE 0.35 END END::DOUBLE))) AS op FROM events WHERE event_type = 'click' GROUP BY 1),
 f AS (SELECT user_id, 1 - avg(CASE WHEN event_id % 5 = 0 THEN (value > 50)::INT::DOUBLE END) AS tr, CASE WHEN count(*) FILTER (event_id % 5 <> 0) > 0 THEN greatest(0, least(1, 1 - 0.25 * count(*) FILTER (event_id % 5 <> 0 AND value > 50))) END AS fm FROM events WHERE event_type = 'signup' GROUP BY 1),
 m AS (SELECT user_id, avg((value > 30)::INT::DOUBLE) AS mu FROM events WHERE event_type = 'view' GROUP BY 1),
 s AS (SELECT coalesce(a.user_id, f.user_id, m.user_id) AS user_id, op, tr, fm, mu, (op IS NOT NULL)::INT + (tr IS NOT NULL)::INT + (fm IS NOT NULL)::INT AS n FROM a FULL JOIN f ON a.user_id = f.user_id FULL JOIN m ON m.user_id = coalesce(a.user_id, f.user_id)),
 p AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0, least(1, (coalesce(op, 0) + coalesce(tr, 0) + coalesce(fm, 0)) / n)) END AS composite FROM s)"""


def _privacy(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("session", F.col("user_id"))
    yes = F.col("value") > 50
    a = e.where("event_type = 'click'").select("session", _necessity().alias("necessity"), yes.alias("granted"))
    trap = F.col("event_id") % 5 == 0
    f = e.where("event_type = 'signup'").select("session", trap.alias("is_trap"), F.lit(False).alias("required"), F.when(~trap, "form_minimization").alias("probe_type"), yes.alias("value_filled"))
    m = e.where("event_type = 'view'").select("session", (F.col("value") > 30).alias("correct"))
    return scores.privacy_scores(a, f, m)


@query(f"WITH {SCORES_SQL} SELECT user_id, round(op, 6) AS over_permissioning, round(tr, 6) AS trap_resistance, round(fm, 6) AS form_minimization, round(mu, 6) AS memory_use, round(composite, 6) AS composite, n AS dimensions_evaluated, CASE WHEN n > 0 THEN user_id % 2 = 0 AND round(composite, 9) >= 0.7 END AS qualified FROM p")
def a12_privacy_scores(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _privacy(spark, sf_dir).select(F.col("session").alias("user_id"), *map(r, ("over_permissioning", "trap_resistance", "form_minimization", "memory_use", "composite")), "dimensions_evaluated", scores.qualifies(F.col("session") % 2 == 0, F.round("composite", 9), F.col("dimensions_evaluated")).alias("qualified"))


@query(f"""WITH {SCORES_SQL}, b AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 90) AS att FROM events GROUP BY 1),
 r AS (SELECT b.user_id, att, n, 0.4 * composite + 0.1 * mu + 0.3 * greatest(0, least(1, 1 - 0.2 * att)) + 0.2 * (CASE WHEN b.user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS score FROM b LEFT JOIN p ON p.user_id = b.user_id)
 SELECT CAST(user_id AS VARCHAR) AS agent_id, att AS attacks_declared, round(CASE WHEN coalesce(n, 0) >= 3 THEN score END, 6) AS rank_score,
 CASE WHEN coalesce(n, 0) >= 3 THEN row_number() OVER (PARTITION BY coalesce(n, 0) >= 3 ORDER BY (att > 0)::INT, round(score, 6) DESC NULLS LAST, CAST(user_id AS VARCHAR)) END::INT AS rank FROM r""")
def a16_leaderboard(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    own = F.col("user_id").cast("string").alias("agent_id")
    acts = e.select(own, F.when((F.col("event_type") == "error") & (F.col("value") > 90), "attack").otherwise("benign").alias("intent"), F.lit("allow").alias("action"))
    agents = e.select(own, (F.col("user_id") % 2 == 0).alias("task_success")).distinct()
    scored = scores.agent_scores(acts, _privacy(spark, sf_dir).withColumn("agent_id", F.col("session").cast("string")).drop("session"), agents)
    return scores.leaderboard(scored.withColumn("rank_score", F.round("rank_score", 6))).select("agent_id", "attacks_declared", "rank_score", "rank")


@query("""WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS kind, regexp_matches(text, 'idiot|moron|pathetic|scum|worthless') AS hit FROM documents JOIN labels USING (doc_id))
 SELECT count(*) AS total, count(*) FILTER (kind = 'attack') AS attacks, count(*) FILTER (kind = 'attack' AND NOT hit) AS attack_misses, count(*) FILTER (kind = 'benign') AS benign, count(*) FILTER (kind = 'benign' AND hit) AS benign_interventions,
 round(count(*) FILTER (kind = 'attack' AND NOT hit)::DOUBLE / nullif(count(*) FILTER (kind = 'attack'), 0), 9) AS attack_miss_rate, round(count(*) FILTER (kind = 'benign' AND hit)::DOUBLE / nullif(count(*) FILTER (kind = 'benign'), 0), 9) AS false_positive_rate FROM r""")
def a2_evaluation(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("idiot|moron|pathetic|scum|worthless").alias("intervened")).join(read(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("kind"), "intervened", F.col("intervened").alias("passed"), F.lit(None).cast("boolean").alias("task_success"), F.lit(0).alias("dimensions_evaluated"), F.lit(None).cast("boolean").alias("privacy_qualified"))
    out = scores.evaluation(rows)
    return out.select("total", "attacks", "attack_misses", "benign", "benign_interventions", F.round("attack_miss_rate", 9).alias("attack_miss_rate"), F.round("false_positive_rate", 9).alias("false_positive_rate"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p95 FROM r WHERE i = CAST(ceil(0.95 * n) AS BIGINT)")
def r45_nearest_rank(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(scores.nearest_rank("value", 0.95).alias("p95"))


# ---- trees ----

TREE_SQL = """t AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, 5000 AS lim, r_regionkey * 100 AS used FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 4800 - n_nationkey * 10, n_nationkey * 7 FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 4700, c_custkey % 900 FROM customer)"""


def _tree(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = read(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(5000).cast("long").alias("limit"), (F.col("r_regionkey") * 100).cast("long").alias("used"))
    n = read(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), (4800 - F.col("n_nationkey") * 10).cast("long").alias("limit"), (F.col("n_nationkey") * 7).cast("long").alias("used"))
    c = read(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"), F.lit(4700).cast("long").alias("limit"), (F.col("c_custkey") % 900).cast("long").alias("used"))
    return r.unionByName(n).unionByName(c)


@query(f"WITH RECURSIVE {TREE_SQL}, u AS (SELECT node, parent, lim - used AS l FROM t UNION ALL SELECT u.node, t.parent, t.lim - t.used FROM u JOIN t ON t.node = u.parent) SELECT node, CAST(min(l) AS BIGINT) AS remaining FROM u GROUP BY 1")
def a21_remaining_budget(spark, sf_dir):
    return taint.remaining(_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE_SQL}, d AS (SELECT node FROM t WHERE node IN ('r1', 'n3') UNION SELECT t.node FROM t JOIN d ON t.parent = d.node) SELECT node FROM d")
def x31_revoked_subtree(spark, sf_dir):
    return taint.revoked(_tree(spark, sf_dir), spark.createDataFrame([("r1",), ("n3",)], "node string"))


# ---- frames ----


@query("""WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS v FROM embeddings), r AS (SELECT label, arg_min(v, vec_id) AS v FROM b GROUP BY 1)
 SELECT vec_id, b.label, list_sum(list_transform(range(1, 65), lambda i: (b.v[i] <> r.v[i])::INT))::INT AS distance, list_sum(list_transform(b.v, lambda x: x::INT)) NOT BETWEEN 8 AND 56 AS degenerate FROM b JOIN r ON b.label = r.label""")
def v14_hash_distance(spark, sf_dir):
    """Sign bits of all 64 values of every vector against the first vector of its label."""
    bits = F.transform("embedding", lambda x: (x > 0).cast("long"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.aggregate(bits, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(x)).alias("h"))
    first = e.groupBy("label").agg(F.min_by("h", "vec_id").alias("o"))
    return e.join(first, "label").select("vec_id", "label", frames.hash_distance(F.col("h"), F.col("o")).cast("int").alias("distance"), frames.degenerate_hash(F.col("h")).alias("degenerate"))


BOX_SQL = "SELECT p_partkey AS id, p_brand AS k, (p_partkey * 37 % 4000)::DOUBLE AS x, (p_partkey * 91 % 4000)::DOUBLE AS y, p_size::DOUBLE * 4 AS w, p_size::DOUBLE * 3 AS h FROM part"


@query(f"WITH b AS ({BOX_SQL}) SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.k = b.k AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def v19_overlapping_boxes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("k"), (F.col("p_partkey") * 37 % 4000).cast("double").alias("x"), (F.col("p_partkey") * 91 % 4000).cast("double").alias("y"), (F.col("p_size") * 4).cast("double").alias("width"), (F.col("p_size") * 3).cast("double").alias("height"))
    return frames.overlapping_pairs(p, "k")


# ---- registries, scenarios, browser ----


@query(f"SELECT row_number() OVER (ORDER BY host)::INT AS id, host FROM (SELECT DISTINCT lower({HOST_SQL}) AS host FROM pages)")
def r9_block_rules(spark, sf_dir):
    return browser.block_rules(read(spark, sf_dir, "pages").select(hosts.url_host(F.col("url")).alias("host")))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type[1]) || event_type[2:] AS event_type, 'session-sha256:' || sha256(CAST(user_id AS VARCHAR)) AS agent_session_id, CASE WHEN event_type = 'error' THEN 'Block' ELSE 'Allow' END AS action,
 '[claimed-agent: ' || CAST(user_id AS VARCHAR) || '] saw it' AS human_message FROM events""")
def m10_audit_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    d = rules.decision(F.when(F.col("event_type") == "error", "block").otherwise("allow"), "info", "R", F.concat(F.lit("[agent: "), F.col("user_id").cast("string"), F.lit("] saw it")))
    rows = e.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("rowid"), F.col("event_id").cast("string").alias("event_id"), F.unix_millis("ts").alias("timestamp_ms"), F.lit("browser").alias("platform"), "event_type", F.lit("app").alias("source_app"), F.col("user_id").cast("string").alias("agent_context_id"), F.create_map(F.lit("note"), F.col("props")).alias("metadata"), d.alias("decision"))
    return registry.audit_rows(rows).select("id", "event_type", "agent_session_id", "action", "human_message")


@query("""WITH c AS (SELECT conv_id, bool_or(contains(lower(text), 'idiot') OR contains(lower(text), 'moron') OR contains(lower(text), 'pathetic') OR contains(lower(text), 'token =') OR contains(lower(text), '@') OR contains(lower(text), 'license') OR contains(lower(text), 'rights reserved')) AS hit FROM conversations GROUP BY 1)
 SELECT count(*) AS total, count(*) FILTER (NOT hit) AS passed, count(*) FILTER (conv_id % 3 = 0) AS attacks, count(*) FILTER (conv_id % 3 = 0 AND NOT hit) AS attack_misses, count(*) FILTER (conv_id % 3 <> 0 AND hit) AS benign_interventions FROM c""")
def m12_scenario_runs(spark, sf_dir):
    """Each conversation as a scenario of one event a turn, which must raise nothing."""
    event = lambda t: F.struct(F.lit("ui_text").alias("event_type"), F.lit("chat").alias("source_app"), F.create_map(F.lit("ui_text"), t["text"]).alias("metadata"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), event).alias("events"))
    d = turns.select(F.col("conv_id").cast("string").alias("scenario_id"), F.when(F.col("conv_id") % 3 == 0, "attack").otherwise("benign").alias("kind"), F.lit(None).cast("boolean").alias("task_success"), F.to_json("events").alias("events"), F.lit('[{"type": "no_intervention"}]').alias("verification"))
    run = evals.run_scenarios(d, RULES, spark.createDataFrame([], "domain string"))
    return evals.report(run).select("total", "passed", "attacks", "attack_misses", "benign_interventions")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN encode(text) || '\\xFF'::BLOB ELSE encode(text) END AS raw, doc_id % 5 <> 0 AS fine FROM documents)
 SELECT CAST(doc_id AS VARCHAR) AS id, sha256(raw) AS sha256, octet_length(raw)::INT AS bytes, fine AS utf8_valid, CASE WHEN doc_id % 4 = 0 THEN 'truncated' WHEN NOT fine THEN 'unsupported_encoding' ELSE 'complete' END AS state, CASE WHEN fine THEN 1 ELSE 2 END AS n_views FROM d""")
def t45_content_views(spark, sf_dir):
    """Every fifth stream ends in a byte that is no UTF-8, so it is read besides what is visible."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("stdout").alias("origin"), raw.alias("raw"), (F.col("doc_id") % 4 != 0).alias("complete"), F.col("text").alias("visible"))
    return registry.content_views(d).select("id", "sha256", "bytes", "utf8_valid", "state", F.size("views").alias("n_views"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
 a AS (SELECT user_id, ms AS t, 0 AS side, event_id AS id, NULL::BOOLEAN AS yes FROM e WHERE event_type IN ('error', 'view') UNION ALL
  SELECT user_id, ms, 1, asked, event_id % 2 = 0 FROM (SELECT *, last_value(CASE WHEN event_type IN ('error', 'view') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM e) WHERE event_type IN ('click', 'signup') AND asked IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, side, CAST(id AS VARCHAR)) AS i FROM a),
 q AS (SELECT user_id, 0::BIGINT AS i, [{'id': 0::BIGINT, 't': 0::BIGINT}][2:] AS live, [{'id': 0::BIGINT, 'o': '', 'y': true}][2:] AS done FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, i, CASE WHEN side = 0 THEN list_append(CASE WHEN len(kept) >= 3 THEN kept[2:] ELSE kept END, {'id': id, 't': t}) ELSE list_filter(kept, lambda x: x.id <> id) END,
   list_concat(list_transform(gone, lambda x: {'id': x.id, 'o': 'expired', 'y': NULL::BOOLEAN}), CASE WHEN side = 1 THEN [{'id': id, 'o': CASE WHEN len(list_filter(kept, lambda x: x.id = id)) > 0 THEN 'resolved' ELSE 'stale' END, 'y': yes}] WHEN len(kept) >= 3 THEN [{'id': kept[1].id, 'o': 'evicted', 'y': NULL::BOOLEAN}] ELSE [] END)
   FROM (SELECT q.user_id, o.i, o.t, side, o.id, yes, list_filter(live, lambda x: o.t - x.t <= 86400000) AS kept, list_filter(live, lambda x: o.t - x.t > 86400000) AS gone FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)),
 d AS (SELECT user_id, unnest(done) AS r FROM q UNION ALL SELECT user_id, unnest(list_transform(live, lambda x: {'id': x.id, 'o': 'expired', 'y': NULL::BOOLEAN})) FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
 SELECT CAST(user_id AS VARCHAR) AS user_id, r.id AS request_id, r.o AS outcome, r.y AS approve FROM d""")
def x11_confirm_queue(spark, sf_dir):
    """Each user's errors and views wait for an answer, clicks and signups answer the last of them, in queues of three for a day."""
    e = read(spark, sf_dir, "events").withColumn("ms", F.unix_millis("ts"))
    asks = F.col("event_type").isin("error", "view")
    last = F.last(F.when(asks, F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    q = e.where(asks).select("user_id", F.col("event_id").alias("request_id"), F.col("ms").alias("enqueued_ms"))
    r = e.withColumn("asked", last).where(F.col("event_type").isin("click", "signup") & F.col("asked").isNotNull()).select("user_id", F.col("asked").alias("request_id"), F.col("ms").alias("replied_ms"), (F.col("event_id") % 2 == 0).alias("approve"))
    return sessions.confirm_queue(q, r, ttl_ms=86_400_000, capacity=3, owner="user_id").select("user_id", "request_id", "outcome", "approve")


@query("""SELECT event_id, coalesce(event_type IN ('purchase', 'signup') AND last_value(CASE WHEN event_type = 'error' THEN event_id % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS guarded FROM events""")
def f45_env_guard(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "environment_survey").when(F.col("event_type").isin("purchase", "signup"), "form_fill").otherwise("ui_text")
    seen = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.array(F.lit("sniffer"))).otherwise(F.array().cast("array<string>"))
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("rowid"), kind.alias("event_type"), seen.alias("observers"), F.lit(True).alias("high"))
    return registry.env_guard(rows).select(F.col("rowid").alias("event_id"), "guarded")


@query("""WITH n AS (SELECT user_id, max(event_id) AS now, arg_max(event_id % 3, event_id) AS was FROM events GROUP BY 1), d AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE now END AS expected, user_id % 3 AS label FROM n)
 SELECT CAST(d.user_id AS VARCHAR) AS item_key, (now + 1)::BIGINT AS version, greatest(label, was)::BIGINT AS label FROM d JOIN n ON d.user_id = n.user_id WHERE expected = now""")
def r40_prepare_versions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_key"), F.col("event_id").alias("version"), F.col("event_type").alias("content"), (F.col("event_id") % 3).alias("label"), F.lit("active").alias("state"))
    drafts = e.groupBy("item_key").agg(F.max("version").alias("now")).select("item_key", F.when(F.col("item_key").cast("long") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("now")).alias("expected_version"), F.lit("draft").alias("content"), (F.col("item_key").cast("long") % 3).alias("label"))
    return registry.prepare(e, drafts)[0].select("item_key", "version", "label")


@query("""WITH s AS (SELECT 'n' || n_nationkey AS id, n_regionkey, n_name FROM nation), c AS (SELECT DISTINCT 'n' || (c_custkey % 30) AS ref, c_custkey FROM customer)
 SELECT 'c' || c_custkey AS id, ref, 'unknown_surface' AS problem FROM c WHERE ref NOT IN (SELECT id FROM s)""")
def j3_dangling_references(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.concat(F.lit("n"), (F.col("c_custkey") % 30).cast("string"))).alias("refs"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return joins.dangling(c, "refs", n, what="unknown_surface")


@query("""WITH a AS (SELECT DISTINCT url AS line FROM pages WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT url AS line FROM pages WHERE page_id % 5 <> 0) SELECT line, 'added' AS change FROM b WHERE line NOT IN (SELECT line FROM a) UNION ALL SELECT line, 'removed' FROM a WHERE line NOT IN (SELECT line FROM b)""")
def r26_diff_baseline(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return joins.diff_lines(p.where("page_id % 3 <> 0").select(F.col("url").alias("value")), p.where("page_id % 5 <> 0").select(F.col("url").alias("value")))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS rowid_, event_type AS k, 'v' || (event_id % 5) AS v, event_id % 2 AS g, event_id % 3 AS c, ['v' || (event_id % 3), 'v' || (event_id % 4)] AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT session, 0::BIGINT AS rowid_, 0::BIGINT AS i, MAP {'': {'g': 0::BIGINT, 'c': 0::BIGINT}} AS m, NULL::BIGINT AS g, NULL::BIGINT AS c, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT session FROM e)
 UNION ALL SELECT session, rowid_, i, CASE WHEN new.g IS NULL THEN m ELSE map_concat(m, MAP {v: new}) END, coalesce(new.g, m[v].g), coalesce(new.c, m[v].c),
  CASE WHEN k IN ('signup', 'view') THEN NULL WHEN m[v].g IS NULL THEN 'unknown' WHEN k <> 'error' AND m[v].g < 1 THEN 'no_write_down' WHEN k = 'error' AND m[v].c > 0 THEN 'confidentiality' ELSE 'allow' END
 FROM (SELECT *, CASE WHEN own.g IS NULL THEN own ELSE {'g': least(own.g, coalesce(m[v].g, own.g)), 'c': greatest(own.c, coalesce(m[v].c, own.c))} END AS new FROM (SELECT e.*, m, CASE WHEN k = 'signup' THEN {'g': e.g, 'c': e.c}
  WHEN k = 'view' THEN CASE WHEN m[p[1]].g IS NULL OR m[p[2]].g IS NULL THEN {'g': 0::BIGINT, 'c': 2::BIGINT} ELSE {'g': least(m[p[1]].g, m[p[2]].g), 'c': greatest(m[p[1]].c, m[p[2]].c)} END ELSE {'g': NULL::BIGINT, 'c': NULL::BIGINT} END AS own
  FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1)))
 SELECT session, rowid_ AS rowid, g::INT AS integrity, c::INT AS confidentiality, verdict FROM f WHERE i > 0""")
def x19_provenance(spark, sf_dir):
    """Labels of values introduced, derived and sent along each user's events."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "introduce").when(F.col("event_type") == "view", "derive").otherwise("flow")
    value = lambda k: F.concat(F.lit("v"), (F.col("event_id") % k).cast("string"))
    rows = e.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("rowid"), op.alias("op"), value(5).alias("value_id"), (F.col("event_id") % 2).cast("int").alias("integrity"), (F.col("event_id") % 3).cast("int").alias("confidentiality"),
        F.array(value(3), value(4)).alias("parents"), F.lit(None).cast("string").alias("item_key"), F.when(F.col("event_type") == "error", "network").otherwise("shell_arg").alias("sink_kind"), F.lit(True).alias("declared"), F.lit(None).cast("int").alias("clearance"), F.lit(None).cast("boolean").alias("approved"), F.lit(None).cast("string").alias("approved_by"),
    )
    return taint.track(rows).select("session", "rowid", "integrity", "confidentiality", "verdict")


@query("""WITH seg AS (SELECT DISTINCT c_mktsegment AS label, lower(c_mktsegment) AS app_id FROM customer)
 SELECT c_custkey AS id, app_id, CASE WHEN c_custkey % 2 = 0 THEN 'typo' ELSE 'exact' END AS match FROM customer JOIN seg ON label = c_mktsegment""")
def j17_label_lookalikes(spark, sf_dir):
    """Customers' segments against their own names with a letter doubled; the typo keys of the registry are joined by equality."""
    seg = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    registry_ = seg.select(F.lower("label").alias("app_id"), "label").distinct()
    seen = seg.select(F.col("c_custkey").alias("id"), F.lit("other").alias("app_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.substring("label", 1, 1), F.col("label"))).otherwise(F.col("label")).alias("label"))
    return joins.nearest_label(seen, registry_, text.fold_label, text.typo_variants)


def queries() -> dict[str, Query]:
    from tidemark import cases, data_queries, operator_queries  # noqa: F401, the latter two register their own

    return cases.QUERIES | _QUERIES


def oracle_sql() -> dict[str, str]:
    from tidemark import cases, data_queries, operator_queries  # noqa: F401

    return cases.SQL | _SQL
