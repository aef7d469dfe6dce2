"""More registered queries: statements of the log, registries, coverage, envelopes and ordered state, each laid over the tables with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ed25519, json_schema
from tidemark.operators import audit, browser, cache, evals, joins, registry, rules, sessions, signatures, taint, trajectory
from tidemark.operators.scale import own_path
from tidemark.queries import AUDIT_SQL, CHAIN_SQL, audit_rows, query, read
from tidemark.sources import config, envelopes

# ---- statements


@query(f"""WITH {AUDIT_SQL}, r AS (SELECT id, event_type FROM audit WHERE event_type = 'error' UNION ALL SELECT CAST(rowid_ - 2 AS VARCHAR) || '/result', 'signup' FROM audit WHERE event_type = 'signup')
 SELECT s.id FROM r s WHERE s.event_type = 'error' AND s.id || '/result' NOT IN (SELECT id FROM r WHERE event_type = 'signup')""")
def q10_dispatched_without_result(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).select("rowid", "id", "event_type")
    both = rows.where("event_type = 'error'").unionByName(rows.where("event_type = 'signup'").withColumn("id", F.concat((F.col("rowid") - 2).cast("string"), F.lit("/result"))))
    return audit.started_without_result(both, "error", "signup").select("id")


@query(f"WITH {AUDIT_SQL} SELECT rowid_ AS rowid, event_type FROM (SELECT * FROM audit WHERE event_type = 'signup' ORDER BY rowid_ LIMIT 30) UNION ALL SELECT rowid_, event_type FROM (SELECT * FROM audit WHERE event_type = 'purchase' ORDER BY rowid_ LIMIT 30)")
def q11_q12_first_of_type(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).select("rowid", "event_type")
    return audit.of_type(rows, "signup", 30).unionByName(audit.of_type(rows, "purchase", 30))


@query(CHAIN_SQL + """, w AS (SELECT record_hash AS x FROM h WHERE i = 3) SELECT log_id, rowid_ AS rowid FROM h WHERE record_hash IN (SELECT x FROM w) OR prev_hash IN (SELECT x FROM w)""")
def q14_either_hash(spark, sf_dir):
    rows = audit.history(audit.chain(audit_rows(spark, sf_dir), audit.canonical_content()), "log_id", "rowid")
    return audit.around_hash(rows, rows.where("step = 3")).select("log_id", "rowid")


@query("SELECT user_id, arg_min(event_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END * 1000000000000 + event_id) AS event_id FROM events GROUP BY 1")
def q16_preferred(spark, sf_dir):
    return audit.preferred(read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "signup", "event_id").select("user_id", "event_id")


@query("SELECT 'documents' AS name, EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL) AS there, (SELECT count(*) FROM documents WHERE doc_id = 7) AS at_7 UNION ALL SELECT 'nothing', EXISTS (SELECT 1 FROM documents WHERE doc_id < 0), 0")
def q13_q22_point_and_exists(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    found = d.agg(F.coalesce(F.bool_or(F.col("text").isNotNull()), F.lit(False)).alias("a"), F.count_if(F.col("doc_id") == 7).alias("n"), F.coalesce(F.bool_or(F.col("doc_id") < 0), F.lit(False)).alias("b"))
    row = lambda name, there, n: F.struct(F.lit(name).alias("name"), there.alias("there"), n.cast("long").alias("at_7"))
    return found.select(F.explode(F.array(row("documents", F.col("a"), F.col("n")), row("nothing", F.col("b"), F.lit(0)))).alias("r")).select("r.*")


@query("SELECT doc_id AS file_index, sha256(text) AS sha256, CAST(len(string_split(text, chr(10))) AS INT) AS chunks FROM documents WHERE text IS NOT NULL")
def q23_ordered_chunks(spark, sf_dir):
    """Lines as chunks, dealt out and put together again."""
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("file_index"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "line"))
    chunks = d.select("file_index", "chunk_index", F.when(F.col("chunk_index") > 0, F.concat(F.lit("\n"), "line")).otherwise(F.col("line")).alias("data")).repartition("file_index", "chunk_index")
    return audit.reassembled(chunks).select("file_index", F.sha2("text", 256).alias("sha256"), "chunks")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS step, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS latest FROM events")
def q25_w14_history(spark, sf_dir):
    return audit.history(read(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "step", "latest")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new'")
def q19_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")).unionByName(spark.createDataFrame([(-1, "new")], "c_custkey long, c_name string"))
    return audit.upsert(c, new, "c_custkey")


@query("SELECT user_id, event_id, event_id AS old_seq, (coalesce(max(CASE WHEN event_id % 2 = 0 THEN event_id END) OVER (PARTITION BY user_id), 0) + row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id))::BIGINT AS seq FROM events QUALIFY event_id % 2 = 1")
def q4_next_sequence(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("seq"))
    new = e.where("event_id % 2 = 1").withColumnRenamed("seq", "old_seq")
    return audit.next_sequence(e.where("event_id % 2 = 0"), new, "event_id", key="user_id").select("user_id", "event_id", "old_seq", "seq")


# ---- ordered state


@query("""WITH e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN ['r' || event_id % 7] WHEN 1 THEN ['r' || event_id % 5, 'x'] ELSE [] END AS r FROM events),
 a AS (SELECT user_id, event_id, flatten(list(r) OVER (PARTITION BY user_id ORDER BY event_id)) AS l FROM e) SELECT user_id, event_id, list_aggregate(list_sort(list_distinct(l)), 'string_agg', ',') AS receivers FROM a""")
def x28_merged_risks(spark, sf_dir):
    k = F.col("event_id") % 4
    name = lambda n: F.concat(F.lit("r"), (F.col("event_id") % n).cast("string"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("rowid"), F.when(k == 0, F.array(name(7))).when(k == 1, F.array(name(5), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("receivers"))
    out = sessions.merged_risks(rows, lists=("receivers",))
    return out.select(F.col("session").alias("user_id"), F.col("rowid").alias("event_id"), F.when(F.size("receivers") > 0, F.array_join("receivers", ",")).alias("receivers"))


@query("""WITH RECURSIVE q AS (SELECT user_id, event_id, event_id % 2 AS c, CAST(floor(value) AS BIGINT) % 50 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 s AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, 300::BIGINT AS r, 200::BIGINT AS a, 150::BIGINT AS b, false AS granted FROM (SELECT DISTINCT user_id FROM q)
 UNION ALL SELECT q.user_id, q.event_id, q.i, CASE WHEN g THEN r - amount ELSE r END, CASE WHEN g AND c = 0 THEN a - amount ELSE a END, CASE WHEN g AND c = 1 THEN b - amount ELSE b END, g
 FROM (SELECT q.*, r, a, b, r >= amount AND CASE c WHEN 0 THEN a ELSE b END >= amount AS g FROM s JOIN q ON q.user_id = s.user_id AND q.i = s.i + 1) q) SELECT event_id, granted FROM s WHERE i > 0""")
def x30_reserve(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    node = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    child = F.concat(node, F.when(F.col("event_id") % 2 == 0, "/a").otherwise("/b"))
    asked = e.select(child.alias("node"), F.col("event_id").alias("rowid"), (F.floor("value") % 50).alias("amount"))
    u = e.select(node.alias("root")).distinct()
    limits = u.select(F.col("root").alias("node"), F.array("root").alias("path"), F.lit(300).cast("long").alias("limit"))
    for name, most in (("/a", 200), ("/b", 150)):
        c = F.concat("root", F.lit(name))
        limits = limits.unionByName(u.select(c.alias("node"), F.array(c, F.col("root")).alias("path"), F.lit(most).cast("long").alias("limit")))
    return registry.reserve(asked, limits).select(F.col("rowid").alias("event_id"), "granted")


@query("""WITH e AS (SELECT event_id, user_id % 97 * 7 + CAST(floor(value) AS BIGINT) % 7 AS k, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY k ORDER BY n) AS l, lead(n) OVER (PARTITION BY k ORDER BY n) AS f FROM e),
 d AS (SELECT a.n, count(DISTINCT b.k) AS reuse FROM p a JOIN p b ON b.n > a.l AND b.n < a.n GROUP BY 1), r AS (SELECT p.*, CASE WHEN l IS NOT NULL THEN coalesce(reuse, 0) END AS reuse FROM p LEFT JOIN d USING (n)), h AS (SELECT *, coalesce(reuse < 40, false) AS hit FROM r),
 v AS (SELECT m.n, u.k, row_number() OVER (PARTITION BY m.n ORDER BY u.n DESC) AS place FROM h m JOIN h u ON u.n < m.n AND (u.f IS NULL OR u.f >= m.n) WHERE NOT m.hit)
 SELECT event_id, reuse, hit, max(h.n) FILTER (NOT hit) OVER (PARTITION BY h.k ORDER BY h.n) AS life, v.k AS evicts FROM h LEFT JOIN v ON v.n = h.n AND v.place = 40""")
def x10_cache_evictions(spark, sf_dir):
    """All events through one cache of 40 keys: what is found there, since when, and which key has to go."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 97 * 7 + F.floor("value") % 7).alias("k"))
    return cache.lru(e, "k", [F.col("ts"), F.col("event_id")], 40).select("event_id", "reuse", "hit", "life", "evicts")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS k, epoch_us(ts) // 1000 AS t, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY k ORDER BY n) AS l FROM e),
 d AS (SELECT a.n, count(DISTINCT b.k) AS reuse FROM p a JOIN p b ON b.n > a.l AND b.n < a.n GROUP BY 1), h AS (SELECT p.*, l IS NOT NULL AND coalesce(reuse, 0) < 8 AS hit FROM p LEFT JOIN d USING (n)),
 g AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY k ORDER BY n) AS life FROM h), q AS (SELECT *, row_number() OVER (PARTITION BY k, life ORDER BY n) AS i FROM g),
 s AS (SELECT event_id, k, life, i, t AS anchor, true AS emit, 0 AS repeats FROM q WHERE i = 1
 UNION ALL SELECT q.event_id, q.k, q.life, q.i, CASE WHEN t - anchor >= 1800000 THEN t ELSE anchor END, t - anchor >= 1800000, CASE WHEN t - anchor >= 1800000 THEN CASE WHEN emit THEN 0 ELSE repeats END WHEN emit THEN 1 ELSE repeats + 1 END FROM s JOIN q ON q.k = s.k AND q.life = s.life AND q.i = s.i + 1)
 SELECT event_id, emit, repeats::INT AS repeats FROM s""")
def x8_x10_bounded_throttle(spark, sf_dir):
    """Each user's events once in half an hour, from a table of eight users."""
    e = read(spark, sf_dir, "events").select("user_id", F.unix_millis("ts").alias("timestamp_ms"), F.col("event_id").alias("rowid"))
    return cache.observe(e, "user_id", window_ms=1_800_000, capacity=8).select(F.col("rowid").alias("event_id"), "emit", "repeats")


@query("SELECT event_id AS node, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w > 1")
def r37_lineage(spark, sf_dir):
    """Each event comes from the one before of its user: where a chain began and how far away that is."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("parent"))
    return taint.lineage(e).select("node", "root", "depth")


@query(f"""WITH {AUDIT_SQL}, s AS (SELECT log_id, rowid_, id, row_number() OVER (PARTITION BY log_id ORDER BY rowid_) AS seq FROM audit), g AS (SELECT * FROM s WHERE rowid_ % 211 <> 7),
 p AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY rowid_) AS n FROM g), q AS (SELECT *, seq = n + coalesce(max(seq - n) OVER (PARTITION BY log_id ORDER BY rowid_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed FROM p),
 t AS (SELECT *, CASE WHEN rowid_ % 97 = 3 THEN 'unsigned' WHEN rowid_ % 89 = 5 THEN 'other_key' WHEN rowid_ % 101 = 2 THEN 'refused' ELSE 'verified' END AS state FROM q),
 u AS (SELECT *, state = 'verified' AND placed AND rowid_ % 307 <> 1 AS ok FROM t)
 SELECT log_id, bool_and(ok) AS ok, count(*) AS total, count(*) FILTER (state <> 'unsigned') AS signed, count(*) FILTER (state = 'unsigned') AS unsigned, count(*) FILTER (state = 'other_key') AS other_key, count(*) FILTER (state = 'verified') AS verified,
 arg_min(id, rowid_) FILTER (NOT ok) AS first_failure_id FROM u GROUP BY 1""")
def m2_verify_record_signatures(spark, sf_dir):
    """Every user's log signed, with records deleted, altered, unsigned, signed by another key, and with signatures of other records."""
    seed = hashlib.sha256(b"a key for queries").digest()
    rows = audit.chain(audit_rows(spark, sf_dir), audit.canonical_content())
    rows = signatures.signed(rows.withColumn("seq", F.row_number().over(Window.partitionBy("log_id").orderBy("rowid"))), seed)
    i = F.col("rowid")
    sig = F.when(i % 97 == 3, "").when(i % 101 == 2, F.concat(F.substring("record_sig", 1, 64), F.reverse(F.substring("record_sig", 65, 64)))).otherwise(F.col("record_sig"))
    rows = rows.withColumn("record_sig", sig).withColumn("signer_key_id", F.when(i % 89 == 5, "0123456789abcdef").otherwise(F.col("signer_key_id")))
    rows = rows.withColumn("human_message", F.when(i % 307 == 1, "edited").otherwise(F.col("human_message"))).where(i % 211 != 7)
    return signatures.verify_signatures(rows, ed25519.public_key(seed))


@query(CHAIN_SQL + " SELECT log_id, rowid_ AS rowid, i AS seq, prev_hash, record_hash FROM h")
def q18_append_with_replays(spark, sf_dir):
    """The log in three batches, each run twice: numbers and chain are those of one run over all rows."""
    rows, path = audit_rows(spark, sf_dir), own_path(spark, "log")
    n = rows.agg(F.max("rowid")).first()[0] + 1
    for batch in range(3):
        part = rows.where((F.col("rowid") * 3 >= n * batch) & (F.col("rowid") * 3 < n * (batch + 1)))
        for _ in range(2):
            audit.append(part, path, batch)
    return spark.read.parquet(f"{path}/rows").select("log_id", "rowid", "seq", "prev_hash", "record_hash")


ICONS = """(SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings)"""


@query(f"""WITH k AS {ICONS}, o AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: CASE WHEN (i * 7 + vec_id) % 64 < vec_id % 7 THEN 1 - b[i] ELSE b[i] END) AS b FROM k),
 d AS (SELECT id, vec_id AS key, list_sum(list_transform(range(1, 65), lambda i: (o.b[i] <> k.b[i])::INT))::INT AS distance FROM o, k)
 SELECT id, min(key) AS key, distance FROM d WHERE distance <= 4 GROUP BY id, distance QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance) = 1""")
def j17_nearest_icons(spark, sf_dir):
    """Sign bits of vectors as icons, up to six of them flipped, against all of them."""
    long = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(x))
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("long")).alias("b"))
    flipped = F.transform("b", lambda x, i: F.when(((i + 1) * 7 + F.col("vec_id")) % 64 < F.col("vec_id") % 7, 1 - x).otherwise(x))
    return joins.nearest_hash(e.select(F.col("vec_id").alias("id"), long(flipped).alias("h")), e.select(F.col("vec_id").alias("key"), long(F.col("b")).alias("h")))


CALLS = {
    "click": {"type": "object", "required": ["user", "props"], "additionalProperties": False, "properties": {"user": {"type": "integer", "maximum": 120}, "value": {"type": "number", "exclusiveMaximum": 90}, "props": {"type": "object", "required": ["k"], "properties": {"k": {"multipleOf": 3}}}, "day": {"pattern": "^2024-01-[012]"}}},
    "view": {"type": "object", "properties": {"tags": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"anyOf": [{"const": "t0"}, {"minLength": 3}]}}}},
    "purchase": {"type": "object", "minProperties": 5, "properties": {"value": {"type": ["integer", "null"]}, "user": {"enum": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]}}},
}


@query("""WITH e AS (SELECT event_id, event_type, user_id, value, strftime(ts, '%Y-%m-%d') AS day, json_extract(props, '$.k')::BIGINT AS k, list_transform(range(event_id % 5), lambda i: 't' || CAST((event_id // 5 + i * i) % 12 AS VARCHAR)) AS tags FROM events)
 SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 9 = 0 THEN ': required props' WHEN user_id > 120 THEN '/user: maximum' WHEN value >= 90 THEN '/value: exclusiveMaximum' WHEN k % 3 <> 0 THEN '/props/k: multipleOf' WHEN day >= '2024-01-30' THEN '/day: pattern' WHEN len(tags) > 0 THEN '/tags: false' END
 WHEN 'view' THEN CASE WHEN len(tags) > 3 THEN '/tags: maxItems' WHEN len(list_distinct(tags)) < len(tags) THEN '/tags: uniqueItems' ELSE '/tags/' || CAST(list_position(list_transform(tags, lambda t: t <> 't0' AND length(t) < 3), true) - 1 AS VARCHAR) || ': anyOf' END
 WHEN 'purchase' THEN CASE WHEN 3 + (event_id % 9 <> 0)::INT + (len(tags) > 0)::INT < 5 THEN ': minProperties' WHEN value <> floor(value) THEN '/value: type' WHEN user_id NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) THEN '/user: enum' END ELSE ': tool' END AS error FROM e""")
def j12_validate_arguments(spark, sf_dir):
    """Tool calls made of events, each held against its tool's schema."""
    e = read(spark, sf_dir, "events")
    tags = F.when(F.col("event_id") % 5 > 0, F.transform(F.sequence(F.lit(0), F.col("event_id") % 5 - 1), lambda i: F.concat(F.lit("t"), ((F.floor(F.col("event_id") / 5) + i * i) % 12).cast("string"))))
    props = F.when(F.col("event_id") % 9 != 0, F.from_json("props", "k long"))
    call = F.to_json(F.struct(F.col("user_id").alias("user"), "value", props.alias("props"), F.date_format("ts", "yyyy-MM-dd").alias("day"), tags.alias("tags")))
    return e.select("event_id", json_schema.arguments_error(F.col("event_type"), call, CALLS).alias("error"))


PLAN = trajectory.Plan(allow=("view", "click", "purchase", "signup"), most={"purchase": 2}, order=("view", "click", "purchase"), terminal="signup")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS k, event_id % 5 <> 0 AS ran, event_id % 7 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 z AS (SELECT MAP {'view': 0, 'click': 0, 'purchase': 0, 'signup': 0} AS m), j AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, m AS n, m AS c, false AS latched, false AS ended, NULL::VARCHAR AS drift FROM (SELECT DISTINCT user_id FROM e), z
 UNION ALL SELECT user_id, event_id, i, CASE WHEN ok THEN c2 ELSE n2 END, c2, CASE WHEN ok THEN false ELSE latched OR d IS NOT NULL END, CASE WHEN ok THEN c2['signup'] > 0 ELSE ended OR (d IS NULL AND ran AND k = 'signup') END, d
 FROM (SELECT *, CASE WHEN d IS NULL THEN map_concat(c, MAP {k: c[k] + 1}) ELSE c END AS c2, CASE WHEN d IS NULL AND ran THEN map_concat(n, MAP {k: n[k] + 1}) ELSE n END AS n2
  FROM (SELECT e.*, j.n, j.c, latched, ended, CASE WHEN latched THEN 'unanchored' WHEN k = 'error' THEN 'out_of_plan' WHEN k = 'purchase' AND n['purchase'] >= 2 THEN 'over_budget' WHEN (k = 'click' AND n['view'] = 0) OR (k = 'purchase' AND (n['view'] = 0 OR n['click'] = 0)) THEN 'out_of_order' WHEN ended THEN 'after_terminal' END AS d
   FROM j JOIN e ON e.user_id = j.user_id AND e.i = j.i + 1))) SELECT event_id, drift FROM j WHERE i > 0""")
def w12_reanchored(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 5 != 0).alias("ran"), (F.col("event_id") % 7 == 0).alias("ok"))
    return trajectory.reanchored(e, PLAN, "ok", session="user_id", order="event_id", kind="event_type", executed="ran", observations=()).select("event_id", "drift")


@query("SELECT count(*) FILTER (emit = 0) AS suppressed_total FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS emit FROM events)")
def a22_suppressed_total(spark, sf_dir):
    """A window longer than the table's month: of each key the first event only is emitted."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis("ts").alias("timestamp_ms"), F.col("event_id").alias("rowid"))
    return sessions.suppressed_total(sessions.throttle(rows, ["user_id", "event_type"], window_ms=10**12))


FLOWS = [
    ("introduce", "card", 1, 2, None, None, None, None, None, None, None, (1, 2, None)), ("introduce", "page", 0, 0, None, None, None, None, None, None, None, (0, 0, None)), ("derive", "mix", None, None, ["card", "page"], None, None, None, None, None, None, (0, 2, None)),
    ("flow", "mix", None, None, None, None, "network", True, None, None, None, (0, 2, "confidentiality")), ("derive", "odd", None, None, ["nothing"], None, None, None, None, None, None, (0, 2, None)), ("memory_save", "card", None, None, None, "k", None, None, None, None, None, (1, 2, None)),
    ("memory_load", "card2", None, None, None, "k", None, None, None, None, None, (1, 2, None)), ("flow", "card2", None, None, None, None, "shell_arg", True, None, None, None, (1, 2, "allow")), ("flow", "mix", None, None, None, None, "shell_arg", True, None, None, None, (0, 2, "no_write_down")),
    ("memory_load", "x", None, None, None, "none", None, None, None, None, None, (None, None, "unknown")), ("declassify", "card", 1, 0, None, None, None, None, None, True, " ", (1, 2, "no_approver")), ("declassify", "card", 1, 0, None, None, None, None, None, False, "me", (1, 2, "not_approved")),
    ("declassify", "card", 1, 0, None, None, None, None, None, True, "me", (1, 0, "ok")), ("flow", "card", None, None, None, None, "network", True, None, None, None, (1, 0, "allow")), ("flow", "card2", None, None, None, None, "app_field", True, 1, None, None, (1, 2, "confidentiality")), ("flow", "ghost", None, None, None, None, "network", True, None, None, None, (None, None, "unknown")),
    ("declassify", "card", 0, 2, None, None, None, None, None, True, "me", (1, 0, "not_a_downgrade")), ("derive", "many", None, None, ["card"] * 1025, None, None, None, None, None, None, (0, 2, "too_many_parents")),
]
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS session, v.* FROM customer, (VALUES {', '.join(f'({i}, {_lit(r[-1][0])}, {_lit(r[-1][1])}, {_lit(r[-1][2])})' for i, r in enumerate(FLOWS))}) AS v(rowid, integrity, confidentiality, verdict)")
def x22_x26_flows(spark, sf_dir):
    """The same steps in a session for each customer: introduce, derive, flow, memory and declassification, each with its known label and verdict."""
    steps = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(FLOWS)], "rowid long, op string, value_id string, integrity int, confidentiality int, parents array<string>, item_key string, sink_kind string, declared boolean, clearance int, approved boolean, approved_by string")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(FLOWS) - 1).cast("long"))).alias("rowid")).join(F.broadcast(steps), "rowid")  # as many rows as steps
    return taint.track(rows).select("session", F.col("rowid").cast("int").alias("rowid"), "integrity", "confidentiality", "verdict")


@query("SELECT CAST(user_id AS VARCHAR) AS session, event_id AS rowid, 'v' || event_id % 9 AS value_id, 0 AS integrity, CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS confidentiality FROM events WHERE event_type IN ('click', 'view') AND event_id % 9 <> 0")
def x27_untrusted_values(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "screen_frame").when(F.col("event_type") == "view", "network_flow").otherwise("form_fill")
    value = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("v"), (F.col("event_id") % 9).cast("string")))
    rows = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("rowid"), kind.alias("event_type"), F.create_map(F.lit("value_id"), value).alias("metadata"), (F.col("event_type") == "click").alias("high"))
    return taint.untrusted(rows, F.col("high")).select("session", "rowid", "value_id", "integrity", "confidentiality")


@query("SELECT page_id, doc, CAST(row_number() OVER (PARTITION BY page_id ORDER BY doc) AS INT) > 0 AND doc % 4 < 2 AS fresh FROM (SELECT page_id, unnest(range(0, 6)) AS doc FROM pages)")
def r15_new_findings(spark, sf_dir):
    """Six findings a page with fingerprints a b a b a b, then the memory of two is full: a, b, then c, d clear it."""
    prints = F.array(*map(F.lit, ["a", "b", "a", "b", "c", "d"]))
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(prints).alias("rowid", "fingerprint"))
    out = browser.new_findings(rows, most=2)
    return out.select("page_id", F.col("rowid").cast("long").alias("doc"), F.col("fresh"))


# ---- registries


@query("""WITH s AS (SELECT 's' || n_nationkey AS id, 'p' || n_regionkey AS paper, CASE WHEN n_nationkey % 3 = 0 THEN 'covered' ELSE 'partial' END AS status, 'u' || n_nationkey AS rule, ['c' || n_nationkey * 3, 'c' || n_nationkey * 3 + 1, 'none' || n_nationkey] AS sc, CASE WHEN n_nationkey % 2 = 0 THEN 'why' END AS note FROM nation),
 c AS (SELECT 'c' || c_custkey AS id, c_custkey % 2 = 0 AS attack, c_custkey % 7 <> 0 AS passed FROM customer), x AS (SELECT id, unnest(sc) AS ref FROM s)
 SELECT id, paper AS ref, 'unknown_paper' AS problem FROM s WHERE paper = 'p4' UNION ALL SELECT id, rule, 'unknown_rule' FROM s WHERE CAST(rule[2:] AS INT) >= 20 UNION ALL SELECT id, ref, 'unknown_scenario' FROM x WHERE ref NOT IN (SELECT id FROM c)
 UNION ALL SELECT x.id, ref, 'failing_scenario' FROM x JOIN c ON c.id = ref WHERE NOT passed UNION ALL SELECT id, rule, 'rule_never_emitted' FROM s WHERE CAST(rule[2:] AS INT) >= 15 UNION ALL SELECT id, NULL, 'missing_note' FROM s WHERE status <> 'covered' AND note IS NULL
 UNION ALL SELECT NULL, id, 'unclaimed_attack' FROM c WHERE attack AND id NOT IN (SELECT ref FROM x)""")
def j1_verify_coverage(spark, sf_dir):
    n = F.col("n_nationkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    nations = read(spark, sf_dir, "nation")
    s = nations.select(name("s", n).alias("id"), name("p", F.col("n_regionkey")).alias("paper"), F.when(n % 3 == 0, "covered").otherwise("partial").alias("status"), F.array(name("u", n)).alias("rules"), F.array(name("c", n * 3), name("c", n * 3 + 1), name("none", n)).alias("scenarios"), F.when(n % 2 == 0, "why").alias("note"))
    c = F.col("c_custkey")
    scenarios = read(spark, sf_dir, "customer").select(name("c", c).alias("id"), F.when(c % 2 == 0, "attack").otherwise("benign").alias("kind"), (c % 7 != 0).alias("passed"))
    ids = lambda p, most: nations.where(n < most).select(name(p, n).alias("id"))
    return joins.verify_coverage(s, ids("p", 4), ids("u", 20), scenarios, ids("u", 15))


@query("""WITH c AS (SELECT 'c' || n_nationkey % 20 AS id, n_name AS claim, 'd' || n_regionkey AS doc, CASE WHEN n_nationkey % 4 = 0 THEN 'absent' ELSE r_name END AS anchor, n_nationkey FROM nation LEFT JOIN region ON r_regionkey = n_regionkey)
 SELECT id, NULL AS ref, 'duplicate_id' AS problem FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, doc, 'missing_document' FROM c WHERE doc = 'd4' UNION ALL SELECT id, anchor, 'anchor_not_found' FROM c WHERE doc <> 'd4' AND anchor = 'absent'
 UNION ALL SELECT id, NULL, 'no_proving_test' FROM c WHERE n_nationkey % 5 = 0 UNION ALL SELECT id, 'f::t' || n_nationkey, 'test_not_found' FROM c WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0""")
def j2_verify_claims(spark, sf_dir):
    n = F.col("n_nationkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    region = read(spark, sf_dir, "region")
    nations = read(spark, sf_dir, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    proof = F.struct(F.lit("f").alias("file"), name("t", n).alias("test"))
    claims = nations.select(name("c", n % 20).alias("id"), name("d", F.col("n_regionkey")).alias("doc"), F.when(n % 4 == 0, "absent").otherwise(F.col("r_name")).alias("anchor"), F.when(n % 5 == 0, F.array().cast("array<struct<file:string,test:string>>")).otherwise(F.array(proof)).alias("proven_by"))
    docs = region.where("r_regionkey < 4").select(name("d", F.col("r_regionkey")).alias("doc"), F.concat(F.lit("about "), "r_name").alias("content"))
    tests = nations.where(n % 3 != 0).select(F.lit("f").alias("file"), name("t", n).alias("test"))
    return joins.verify_claims(claims, docs, tests)


@query("""WITH t AS (SELECT c_custkey, c_nationkey % 4 AS v, 'T' || c_custkey % 10 AS t FROM customer) SELECT c_custkey, CASE WHEN v = 1 AND t IN ('T1', 'T2') THEN t || 'b' WHEN v = 2 AND t = 'T1' THEN 'T9' ELSE t END AS current FROM t""")
def j4_resolve_technique(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("version"), F.concat(F.lit("T"), (F.col("c_custkey") % 10).cast("string")).alias("technique"))
    m = spark.createDataFrame([(1, "T1", "T1b"), (1, "T2", "T2b"), (2, "T1", "T9")], "version int, old_id string, new_id string")
    return registry.resolve_technique(rows, m).select("c_custkey", "current")


@query("SELECT c_mktsegment AS evidence, c_nationkey % 3 AS status, count(*) AS n FROM customer GROUP BY 1, 2")
def j5_a17_catalog_summary(spark, sf_dir):
    return registry.catalog_summary(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("evidence"), (F.col("c_nationkey") % 3).alias("status")))


@query("""WITH o AS (SELECT 'tool' AS type, CASE WHEN n_nationkey % 6 = 5 THEN 'other--' ELSE 'tool--' END || n_nationkey % 23 AS id, CASE WHEN n_nationkey % 7 = 0 THEN '2.0' ELSE '2.1' END AS v, 'tool--' || n_nationkey + 3 AS ref FROM nation)
 SELECT id, NULL AS ref, 'version' AS problem FROM o WHERE v <> '2.1' UNION ALL SELECT id, NULL, 'duplicate_id' FROM o GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, NULL, 'id_type' FROM o WHERE id LIKE 'other%' UNION ALL SELECT id, ref, 'dangling' FROM o WHERE ref NOT IN (SELECT id FROM o)""")
def s15_j6_check_stix(spark, sf_dir):
    n = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    own = F.concat(F.when(n % 6 == 5, "other--").otherwise("tool--"), (n % 23).cast("string"))
    rows = read(spark, sf_dir, "nation").select(F.lit("tool").alias("type"), own.alias("id"), F.when(n % 7 == 0, "2.0").otherwise("2.1").alias("spec_version"), F.concat(F.lit("tool--"), (n + 3).cast("string")).alias("source_ref"), none.alias("target_ref"), F.lit(None).cast("array<string>").alias("object_refs"))
    return config.check_stix(rows)


@query("""SELECT '{"type":"attack-pattern","id":"attack-pattern--T' || r_regionkey || '","spec_version":"2.1","name":"' || r_name || '","x_coverage":[' || string_agg('{"surface":"' || n_name || '","status":"s' || n_nationkey % 3 || '"}', ',' ORDER BY n_name) || ']}' AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def s16_export_stix(spark, sf_dir):
    t = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    techniques = read(spark, sf_dir, "region").select(t("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    coverage = read(spark, sf_dir, "nation").select(t("n_regionkey").alias("technique"), F.col("n_name").alias("surface"), F.concat(F.lit("s"), (F.col("n_nationkey") % 3).cast("string")).alias("status"))
    return config.export_stix(techniques, coverage)


@query("""WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'pending' END AS state FROM customer)
 SELECT CAST(k AS VARCHAR) AS review_id, CASE WHEN state = 'pending' THEN 's' || k END AS service, CASE WHEN state <> 'pending' OR k % 5 = 0 OR k % 7 = 0 THEN 'rejected' WHEN k % 4 = 0 THEN 'expired' WHEN k % 2 = 0 THEN 'approved' ELSE 'denied' END AS outcome FROM p""")
def j10_decide_registrations(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    old = c.select(F.concat(F.lit("s"), k.cast("string")).alias("service"), F.lit(1).alias("rowid"), F.lit("pending").alias("state"), k.cast("string").alias("review_id"), F.lit("n").alias("nonce"), F.lit("d").alias("digest"), F.when(k % 4 == 0, 50).otherwise(150).alias("expires_ms"))
    rows = old.unionByName(old.where("cast(review_id as long) % 3 = 1").withColumn("rowid", F.lit(2)).withColumn("state", F.lit("approved")))
    replies = c.select(k.cast("string").alias("review_id"), F.when(k % 5 == 0, "x").otherwise("n").alias("nonce"), F.when(k % 7 == 0, "x").otherwise("d").alias("digest"), (k % 2 == 0).alias("approve"))
    return registry.decide_registrations(rows, replies, 100)


@query("""WITH p AS (SELECT 'a' || c_custkey AS agent_id, c_custkey AS k FROM customer) SELECT agent_id, 'p1' AS probe_id, 'missing_probe' AS problem FROM p WHERE k % 3 = 0 UNION ALL SELECT agent_id, 'p2', 'wrong_dimension' FROM p WHERE k % 4 = 0 UNION ALL SELECT agent_id, 'odd', 'unknown_probe' FROM p WHERE k % 5 = 0 UNION ALL SELECT agent_id, 'p2', 'duplicate_answer' FROM p WHERE k % 7 = 0""")
def j16_comparability(spark, sf_dir):
    k = F.col("c_custkey")
    one = lambda p, d, when: F.when(when, F.struct(F.lit(p).alias("probe_id"), d.alias("dimension")))
    d2 = F.when(k % 4 == 0, "x").otherwise("tr")
    answers = F.array_compact(F.array(one("p1", F.lit("op"), k % 3 != 0), one("p2", d2, F.lit(True)), one("p2", d2, k % 7 == 0), one("odd", F.lit("op"), k % 5 == 0)))
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), k.cast("string")).alias("agent_id"), F.explode(answers).alias("p")).select("agent_id", "p.*")
    return joins.comparability(rows, spark.createDataFrame([("p1", "op"), ("p2", "tr")], "probe_id string, dimension string"))


@query("""WITH w AS (SELECT user_id, count(*) AS n, max(event_id) AS p FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS log_id, CASE user_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'rolled_back' WHEN 2 THEN 'forked' WHEN 3 THEN 'receipts_deleted' ELSE 'ok' END AS state FROM w""")
def m3_check_against(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("log_id")).agg(F.max("event_id").alias("position"), F.count("*").alias("count")).withColumns({"record_hash": F.lit("h"), "receipt_count": F.lit(3), "receipt_hash": F.lit("r")})
    k = F.col("log_id").cast("long") % 5
    now = w.where(k != 0).withColumns({"position": F.col("position") - F.when(k == 1, 1).otherwise(0), "record_hash": F.when(k == 2, "g").otherwise("h"), "receipt_count": F.when(k == 3, 2).otherwise(3)})
    return audit.check_against(now, w)


@query(CHAIN_SQL + " SELECT log_id, CAST(log_id AS BIGINT) % 2 = 0 AS included FROM (SELECT DISTINCT log_id FROM h)")
def m4_check_inclusion(spark, sf_dir):
    rows = audit.chain(audit_rows(spark, sf_dir), audit.canonical_content()).select("log_id", "rowid", "record_hash")
    heads = audit.head(rows).select("log_id", F.when(F.col("log_id").cast("long") % 2 == 0, F.col("record_hash")).otherwise(F.lit("gone")).alias("record_hash"))
    return audit.check_inclusion(rows, heads).select("log_id", "included")


@query("""WITH a AS (SELECT 'a' || c_custkey AS agent_id, c_custkey % 2 AS f, c_custkey % 3 AS g FROM customer)
 SELECT agent_id, 'permission_request' AS event_type, 'email' AS key, true AS value, false AS required FROM a WHERE g = 0 UNION ALL SELECT agent_id, 'form_fill', 'name', f = 1, true FROM a UNION ALL SELECT agent_id, 'form_fill', 'email', false, false FROM a""")
def m14_suite_events(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), k.cast("string")).alias("agent_id"), F.lit("p").alias("probe_id"), F.when(k % 2 == 1, F.array(F.lit("name"))).otherwise(none).alias("filled"), F.when(k % 3 == 0, F.array(F.lit("email"))).otherwise(none).alias("granted"))
    return evals.suite_events(rows, spark.createDataFrame([("p", "fm", ["name"], ["email"])], "probe_id string, dimension string, required_low array<string>, optional_high array<string>")).drop("probe_id")


@query("SELECT 'f' || n_nationkey AS file, n_nationkey < 20 AS listed FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'gone', false WHERE true")
def m15_manifest(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("n_nationkey").cast("string"))
    n = read(spark, sf_dir, "nation")
    names = n.where("n_nationkey % 2 = 0").select(name.alias("file")).unionByName(spark.createDataFrame([("gone",)], "file string"))
    listed, lost = evals.manifest(n.where("n_nationkey < 20").select(name.alias("file")), names)
    return listed.withColumn("listed", F.lit(True)).unionByName(lost.withColumn("listed", F.lit(False)))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS r FROM events GROUP BY 1) SELECT user_id AS service, 'd' || r AS digest, u.tool AS tool, user_id || '__' || u.tool AS alias FROM l, (VALUES ('read'), ('write')) AS u(tool) WHERE t IN ('view', 'click')""")
def r33_published(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.col("event_id").alias("rowid"), F.when(F.col("event_type").isin("view", "click"), "approved").otherwise("pending").alias("state"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("digest"), F.array(F.lit("read"), F.lit("write")).alias("tools"))
    return registry.published(rows)


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'old' AS bound_to FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0")
def r35_import_sources(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "event_id")
    return registry.import_sources(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "old").select("id", "bound_to")


@query(f"""WITH {AUDIT_SQL}, r AS (SELECT id, event_type, action FROM audit WHERE event_type = 'error' UNION ALL SELECT CAST(rowid_ - 1 AS VARCHAR) || '/result', 'view', action FROM audit WHERE event_type = 'view')
 SELECT * FROM r UNION ALL SELECT id || '/result', 'view', 'unknown' FROM r WHERE event_type = 'error' AND id || '/result' NOT IN (SELECT id FROM r WHERE event_type = 'view')""")
def r36_recovered(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    both = rows.where("event_type = 'error'").select("id", "event_type", "action").unionByName(rows.where("event_type = 'view'").select(F.concat((F.col("rowid") - 1).cast("string"), F.lit("/result")).alias("id"), "event_type", "action"))
    return joins.recovered(both, "error", "view")


ENTRIES_SQL = "e AS (SELECT CAST(user_id AS VARCHAR) AS item_key, event_id AS version, event_type AS content, event_id % 3 AS label FROM events), t AS (SELECT item_key, max(version) AS now, max(label) AS most, min(version) AS first FROM e GROUP BY 1)"


def _entries(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_key"), F.col("event_id").alias("version"), F.col("event_type").alias("content"), (F.col("event_id") % 3).alias("label"), F.lit("active").alias("state"))


@query(f"WITH {ENTRIES_SQL} SELECT e.item_key, now + 1 AS version, content, label, 'revoked' AS state FROM e JOIN t ON e.item_key = t.item_key AND version = now WHERE CAST(e.item_key AS BIGINT) % 2 = 0")
def r41_change_state(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return registry.change_state(e, e.where("cast(item_key as long) % 2 = 0").select("item_key").distinct(), "revoked")


@query(f"WITH {ENTRIES_SQL} SELECT e.item_key, now + 1 AS version, content, most AS label, 'active' AS state FROM e JOIN t ON e.item_key = t.item_key AND version = first")
def r42_restore(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return registry.restore(e, e.groupBy("item_key").agg(F.min("version").alias("version")))


@query("SELECT host, kind, expires_ms FROM (SELECT url AS host, CASE WHEN page_id % 2 = 0 THEN 'session' ELSE 'persistent' END AS kind, CASE WHEN page_id % 2 = 0 THEN page_id END AS expires_ms FROM pages) WHERE kind = 'persistent' OR expires_ms > 20")
def r11_prune_blocklist(spark, sf_dir):
    even = F.col("page_id") % 2 == 0
    rows = read(spark, sf_dir, "pages").select(F.col("url").alias("host"), F.when(even, "session").otherwise("persistent").alias("kind"), F.when(even, F.col("page_id")).alias("expires_ms"))
    return browser.prune_blocklist(rows, 20)


@query("""SELECT page_id || '-0' AS event_id, 'browser' AS platform, 'ui_tree_delta' AS event_type, 'shop' AS source_app, 't' || page_id AS said FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id || '-1', 'browser', 'form_fill', 'shop', 'email' FROM pages WHERE page_id % 3 <> 0""")
def r16_findings_to_events(spark, sf_dir):
    found = lambda kind, text, key: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("marker"), F.lit(key).cast("string").alias("profile_key"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.lit("shop").alias("app"), (F.col("page_id") % 3 == 0).alias("is_mail"), F.array(found("hidden", F.concat(F.lit("t"), F.col("page_id").cast("string")), None), found("form_fill", F.lit(None), "email")).alias("findings"))
    return browser.findings_to_events(rows).select("event_id", "platform", "event_type", "source_app", F.coalesce(F.col("metadata")["ui_text"], F.col("metadata")["profile_key"]).alias("said"))


@query("""WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id AS run, n::BIGINT + (n % 2 = 0)::BIGINT * 0 AS rows, n % 4 = 1 AS ok FROM g""")
def r46_check_timing(spark, sf_dir):
    """Each user's rows as one run in the right pattern, whose length decides."""
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 2
    pattern = F.array(*map(F.lit, ("GatewayDecision", "GatewayExecutionStarted", "GatewaySourceObserved", "GatewayExecutionFinished")))
    rows = read(spark, sf_dir, "events").withColumn("i", i).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.when(F.col("i") < 0, "GatewaySourceStorageBinding").otherwise(F.get(pattern, F.pmod("i", F.lit(4)))).alias("event_type"))
    return evals.check_timing(rows)


@query("SELECT event_type AS name, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) <= 95 AS passed FROM events GROUP BY 1")
def r45_check_budget(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("value_ms"))
    return evals.check_budget(e, e.select("name").distinct().withColumn("budget_ms", F.lit(95.0))).select("name", "p95", "n", "passed")


# ---- memory, pages before and after, envelopes


@query("SELECT doc_id AS item_key FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license') AND doc_id % 3 <> 0 ORDER BY doc_id LIMIT 4")
def t46_search_memory(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), F.lit(1).alias("version"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "revoked").otherwise("active").alias("state"), F.lit(None).cast("long").alias("expires_ms"))
    return sessions.search_memory(d, ["license", "the"], 0).select("item_key")


@query("SELECT event_id, 'UI-REVALIDATE' AS rule_id FROM events WHERE event_id % 6 IN (1, 5)")
def f47_revalidate(spark, sf_dir):
    k = F.col("event_id") % 6
    said = lambda x: F.create_map(F.lit("ui_text"), F.when(x, "new").otherwise("old"), F.lit("noise"), F.col("props"))
    e = read(spark, sf_dir, "events").select("event_id", F.lit("form_fill").alias("event_type"), F.lit("a").alias("source_app"), "props")
    after = e.withColumn("source_app", F.when(k == 5, "b").otherwise("a")).withColumn("metadata", said(k == 1))
    return rules.revalidate(e.withColumn("metadata", said(F.lit(False))), after).select("event_id", F.col("decision.rule_id").alias("rule_id"))


DEVICE_SQL = """CASE event_id % 6 WHEN 0 THEN 'ui_tree_delta|App|{"ui_text":"t' || event_id || '"}' WHEN 1 THEN 'form_fill|com.x|{"package":"com.x","field_id":"","profile_key":"email","required":"false","value_filled":"true","is_trap":"false"}'
 WHEN 2 THEN 'deeplink|src|{"ui_text":"app://x","uri":"app://x"}' WHEN 3 THEN 'environment_survey|src|{"ui_text":"[AG_FOREIGN_A11Y_SERVICE]","foreign_a11y_services":"a,b","env_surveyed":"true"}' WHEN 4 THEN 'permission_request|src|{"item_key":"email","necessity":"unnecessary","granted":"true"}' END"""


@query(f"SELECT event_id, 0 AS position, split_part({DEVICE_SQL}, '|', 1) AS event_type, split_part({DEVICE_SQL}, '|', 2) AS source_app, split_part({DEVICE_SQL}, '|', 3) AS metadata, NULL AS error FROM events WHERE event_id % 6 <> 5 UNION ALL SELECT event_id, 0, NULL, NULL, NULL, 'unknown event type: odd' FROM events WHERE event_id % 6 = 5")
def s2_s5_convert_envelopes(spark, sf_dir):
    """A device envelope for each event, one of six kinds, the last unknown: events and rejects."""
    k, q = F.col("event_id") % 6, F.lit
    item = (
        F.when(k == 0, F.concat(q('{"type":"ui_text","app":" App ","text":"t'), F.col("event_id").cast("string"), q('"}'))).when(k == 1, q('{"type":"form_fill","package":"com.x","profile_key":"email"}')).when(k == 2, q('{"type":"deeplink","uri":"app://x"}'))
        .when(k == 3, q('{"type":"env_survey","foreign_a11y_services":["a","b"]}')).when(k == 4, q('{"type":"permission_request","item_key":"email","granted":true}')).otherwise(q('{"type":"odd"}'))
    )
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json(F.concat(q('{"type":"b","source":"src","events":['), item, q("]}")), envelopes.ENVELOPE).alias("e")).select("event_id", "e.*")
    good, bad = envelopes.convert(rows.withColumn("source", F.when(k == 1, F.lit(None).cast("string")).otherwise(F.col("source"))), "android", envelopes.DEVICE, id_col="event_id")
    none = F.lit(None).cast("string")
    made = good.select(F.split("event_id", "-")[0].cast("long").alias("event_id"), F.split("event_id", "-")[1].cast("int").alias("position"), "event_type", "source_app", F.to_json("metadata").alias("metadata"), none.alias("error"))
    return made.unionByName(bad.select("event_id", "position", none.alias("event_type"), none.alias("source_app"), none.alias("metadata"), "error"))


@query("SELECT page_id, 'ui_tree_delta' AS event_type, 'Pay ' || url AS said FROM pages UNION ALL SELECT page_id, 'form_fill', 'email|form|' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END FROM pages")
def s6_s8_snapshots(spark, sf_dir):
    """A tree of three nodes for each page: its text and its form field."""
    node = lambda i, role, text, value, editable, label: F.struct(F.lit(i).alias("id"), F.lit(0).alias("parent"), F.lit(role).alias("role"), text.cast("string").alias("text"), value.cast("string").alias("value"), F.lit(editable).alias("editable"), F.lit(label).cast("string").alias("label"))
    none = F.lit(None)
    value = F.when(F.col("page_id") % 2 == 0, "x@y.z").otherwise(" ")
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("event_id"), F.lit(0).alias("timestamp_ms"), F.lit("android").alias("platform"), F.lit("form").alias("source_app"), F.array(node(1, "text", F.lit(" Pay "), none, False, None), node(2, "edit", none, value, True, "Email"), node(3, "text", F.col("url"), none, False, None)).alias("nodes"))
    shown = envelopes.snapshot_events(rows).select(F.col("event_id").cast("long").alias("page_id"), "event_type", F.col("metadata")["ui_text"].alias("said"))
    fills = envelopes.snapshot_form_fills(rows).select(F.split("event_id", "-")[0].cast("long").alias("page_id"), "event_type", F.concat_ws("|", F.col("metadata")["profile_key"], "source_app", F.col("metadata")["value_filled"]).alias("said"))
    return shown.unionByName(fills)


@query(f"WITH {AUDIT_SQL} SELECT count(*) AS records, count(DISTINCT agent_session_id) AS sessions, max(rowid_) AS last_rowid, arg_max(timestamp_ms, rowid_) AS last_ms, count(*) FILTER (action = 'Block') AS blocked, count(*) FILTER (action IN ('Block', 'Alert') AND user_decision IS NULL) AS waiting FROM audit")
def a23_status(spark, sf_dir):
    return audit.status(audit_rows(spark, sf_dir))


@query("SELECT 'a' || user_id % 6 AS adapter_id, count(*) FILTER (event_type = 'view') AS verified, count(*) FILTER (event_type = 'click') AS unsigned, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1")
def r21_ingress_counts(spark, sf_dir):
    t = F.col("event_type")
    return registry.ingress_counts(read(spark, sf_dir, "events").select(F.concat(F.lit("a"), (F.col("user_id") % 6).cast("string")).alias("adapter_id"), F.when(t == "view", "verified").when(t == "click", "unsigned").when(t == "error", "rejected").alias("outcome")))


@query("""WITH l AS (SELECT user_id AS service, arg_max(event_type, event_id) AS t, 'd' || max(event_id) % 3 AS digest FROM events GROUP BY 1), h AS (SELECT user_id AS service, unnest(['read', 'drop']) AS tool, 'd' || user_id % 3 AS digest FROM (SELECT DISTINCT user_id FROM events))
 SELECT h.service, tool, h.digest, CASE WHEN tool = 'drop' OR l.t NOT IN ('view', 'click') THEN 'gone' WHEN l.digest <> h.digest THEN 'changed' ELSE 'ok' END AS state FROM h JOIN l USING (service)""")
def r34_j9_verify_bindings(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    d = lambda c: F.concat(F.lit("d"), (F.col(c) % 3).cast("string"))
    rows = e.select(F.col("user_id").alias("service"), F.col("event_id").alias("rowid"), F.when(F.col("event_type").isin("view", "click"), "approved").otherwise("pending").alias("state"), d("event_id").alias("digest"), F.array(F.lit("read"), F.lit("write")).alias("tools"))
    held = e.select("user_id").distinct().select(F.col("user_id").alias("service"), F.explode(F.array(F.lit("read"), F.lit("drop"))).alias("tool"), d("user_id").alias("digest"))
    return registry.verify_bindings(held, rows)


@query("SELECT user_id AS source_id, min(event_id) AS rowid FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type <> 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1")
def x33_observed(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("rowid"), "event_type")
    held = e.where("event_type = 'view'").groupBy("source_id").agg(F.min("rowid").alias("rowid"))
    return registry.observed(held, e.where("event_type <> 'view'").drop("event_type"))


@query("""WITH t AS (SELECT 't' || n_nationkey AS id, 's' || n_regionkey AS ref FROM nation), c AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE 'c' || c_custkey // 2 END AS id, 't' || c_custkey % 40 AS ref FROM customer)
 SELECT 'techniques' AS entity, id, ref, 'unknown_stages' AS problem FROM t WHERE ref = 's4' UNION ALL SELECT 'cases', id, ref, 'unknown_techniques' FROM c WHERE ref NOT IN (SELECT id FROM t) UNION ALL SELECT 'cases', id, NULL, 'duplicate_id' FROM c GROUP BY 2 HAVING count(*) > 1
 UNION ALL SELECT 'cases', id, NULL, 'blank_id' FROM c WHERE id = ' '""")
def j3_validate_catalog(spark, sf_dir):
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    c = F.col("c_custkey")
    stages = read(spark, sf_dir, "region").where("r_regionkey < 4").select(name("s", F.col("r_regionkey")).alias("id"))
    techniques = read(spark, sf_dir, "nation").select(name("t", F.col("n_nationkey")).alias("id"), F.array(name("s", F.col("n_regionkey"))).alias("stages"))
    cases = read(spark, sf_dir, "customer").select(F.when(c % 50 == 0, " ").otherwise(name("c", F.floor(c / 2))).alias("id"), F.array(name("t", c % 40)).alias("techniques"))
    return joins.validate_catalog({"stages": stages, "techniques": techniques, "cases": cases})
