"""Referential checks, reconciliation of a trace with the audit log, execution views, diffs and registries, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scale import carried

#: Tolerances in milliseconds, and observation rows of the audit log.
END_GRACE_MS, HEARTBEAT_MS = 2_000, 10_000
OBSERVATIONS = ("UiTreeDelta", "FormFill", "NetworkFlow", "Screenshot")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, refs: str, ids: DataFrame, id_col: str = "id", what: str = "dangling") -> DataFrame:
    """(id, ref, problem) of references in an array column that aren't ids of the other frame."""
    each = rows.select("id", F.explode(refs).alias("ref"))
    known = ids.select(F.col(id_col).alias("ref")).distinct()
    return each.join(known, "ref", "left_anti").select("id", "ref", F.lit(what).alias("problem"))


#: References of a knowledge catalog: entity, its column of references, the entity they name.
CATALOG = (("techniques", "stages", "stages"), ("cases", "techniques", "techniques"), ("rules", "techniques", "techniques"), ("scenarios", "rules", "rules"), ("coverage", "rules", "rules"), ("coverage", "scenarios", "scenarios"))


def validate_catalog(entities: dict[str, DataFrame], relations=CATALOG) -> DataFrame:
    """Problems (entity, id, ref, problem) of a catalog of frames (id, and arrays of references): repeated ids, blank ids, and references to nothing."""
    none = F.lit(None).cast("string")
    out = []
    for name, rows in entities.items():
        out.append(duplicates(rows, "id").select(F.lit(name).alias("entity"), "id", none.alias("ref"), F.lit("duplicate_id").alias("problem")))
        out.append(rows.where(F.trim(F.coalesce("id", F.lit(""))) == "").select(F.lit(name).alias("entity"), "id", none.alias("ref"), F.lit("blank_id").alias("problem")))
    for name, column, target in relations:
        if name in entities and target in entities:
            out.append(dangling(entities[name], column, entities[target], what=f"unknown_{target}").select(F.lit(name).alias("entity"), "id", "ref", "problem"))
    return union_all(*out)


def verify_coverage(surfaces: DataFrame, papers: DataFrame, rules: DataFrame, scenarios: DataFrame, emitted: DataFrame) -> DataFrame:
    """Problems (id, ref, problem) of surfaces (id, paper, status, rules, scenarios, note): unknown papers, rules and scenarios, failing
    scenarios, rules that nothing emits, missing notes, and attack scenarios that no surface claims.

    papers, rules, emitted: id. scenarios: id, kind, passed.
    """
    claimed = surfaces.select("id", F.explode("scenarios").alias("ref"))
    failing = claimed.join(scenarios.where("not passed").select(F.col("id").alias("ref")), "ref").select("id", "ref", F.lit("failing_scenario").alias("problem"))
    silent = surfaces.select("id", F.explode("rules").alias("ref")).join(emitted.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "ref", F.lit("rule_never_emitted").alias("problem"))
    bare = surfaces.where((F.col("status") != "covered") & (F.coalesce("note", F.lit("")) == "")).select("id", F.lit(None).cast("string").alias("ref"), F.lit("missing_note").alias("problem"))
    orphans = scenarios.where("kind = 'attack'").select(F.col("id").alias("ref")).join(claimed.select("ref").distinct(), "ref", "left_anti").select(F.lit(None).cast("string").alias("id"), "ref", F.lit("unclaimed_attack").alias("problem"))
    one = surfaces.select("id", F.array("paper").alias("papers"), "rules", "scenarios")
    return union_all(dangling(one, "papers", papers, what="unknown_paper"), dangling(one, "rules", rules, what="unknown_rule"), dangling(one, "scenarios", scenarios, what="unknown_scenario"), failing, silent, bare, orphans)


def verify_claims(claims: DataFrame, documents: DataFrame, tests: DataFrame) -> DataFrame:
    """Problems of claims (id, doc, anchor, proven_by: array<struct<file, test>>): duplicate ids, missing documents, anchors that aren't
    there, claims without tests, and tests that don't exist. documents: doc, content. tests: file, test."""
    row = lambda p, ref=None: ("id", (F.lit(None).cast("string") if ref is None else ref).alias("ref"), F.lit(p).alias("problem"))
    again = duplicates(claims, "id").select(*row("duplicate_id"))
    placed = claims.join(documents, "doc", "left")
    missing = placed.where("content is null").select(*row("missing_document", F.col("doc")))
    lost = placed.where(F.col("content").isNotNull() & ~F.col("content").contains(F.col("anchor"))).select(*row("anchor_not_found", F.col("anchor")))
    unproven = claims.where(F.size("proven_by") <= 0).select(*row("no_proving_test"))
    proofs = claims.select("id", F.explode("proven_by").alias("p")).select("id", "p.file", "p.test")
    absent = proofs.join(tests, ["file", "test"], "left_anti").select(*row("test_not_found", F.concat_ws("::", "file", "test")))
    return union_all(again, missing, lost, unproven, absent)


def closed_intervals(trace: DataFrame) -> DataFrame:
    """(from_ms, to_ms) in which no session was open: from the grace behind each end to the next start."""
    marks = trace.where(F.col("kind").isin("session_start", "session_end")).select("ts", (F.col("kind") == "session_start").alias("start"))
    marks = marks.withColumn("__s", F.when(F.col("start"), F.col("ts")))
    marks = carried(marks, [F.desc("ts"), F.desc("start")], "__s", "next")  # from the end of the trace, the last start seen is the next one
    return marks.where("not start").select((F.col("ts") + END_GRACE_MS).alias("from_ms"), F.coalesce("next", F.lit(2**62)).alias("to_ms"))


def _so_far(both: DataFrame, value: Column, into: str, by: tuple[str, ...]) -> DataFrame:
    """both (__t, __side, ...) with the largest value up to each row: within each key, or through all rows, which are then spread over partitions by time."""
    if not by:
        return carried(both.withColumn("__v", value), [F.col("__t"), F.col("__side")], "__v", into, largest=True).drop("__v")
    return both.withColumn(into, F.max(value).over(Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def backed(rows: DataFrame, ticks: DataFrame, ts: str = "ts", within_ms: int = HEARTBEAT_MS, *by: str) -> DataFrame:
    """rows with last_tick, the latest tick at or before them, and backed: it is at most within_ms ago. One ordered pass over both."""
    both = rows.withColumn("__r", F.struct(*rows.columns)).select(*by, F.col(ts).alias("__t"), F.lit(1).alias("__side"), "__r").unionByName(ticks.select(*by, F.col(ts).alias("__t"), F.lit(0).alias("__side")), allowMissingColumns=True)
    out = _so_far(both, F.when(F.col("__side") == 0, F.col("__t")), "last_tick", by).where("__side = 1")
    return out.select("__r.*", "last_tick", F.coalesce(F.col("__t") - F.col("last_tick") <= within_ms, F.lit(False)).alias("backed"))


def inside(rows: DataFrame, intervals: DataFrame, ts: str, *by: str) -> DataFrame:
    """rows whose time lies inside an interval (from_ms, to_ms), exclusive at both ends. One ordered pass over both: a row is inside if
    the furthest end of the intervals that began before it is behind it."""
    both = rows.withColumn("__r", F.struct(*rows.columns)).select(*by, F.col(ts).alias("__t"), F.lit(0).alias("__side"), "__r").unionByName(intervals.select(*by, F.col("from_ms").alias("__t"), F.lit(1).alias("__side"), F.col("to_ms").alias("__to")), allowMissingColumns=True)
    return _so_far(both, F.col("__to"), "__last", by).where("__side = 0 and __t < __last").select("__r.*")


def reconcile(trace: DataFrame, rows: DataFrame) -> DataFrame:
    """Six checks (check, pass, problems) of a trace (see schemas.TRACE) against audit rows (id, timestamp_ms, event_type, rule_id, user_decision)."""
    audit = rows.select(F.col("id").alias("aid"), "timestamp_ms", "event_type", F.col("rule_id").alias("row_rule"), "user_decision")
    kind = F.col("kind")
    t = trace.agg(F.count_if(kind == "session_start").alias("a"), F.count_if(kind == "session_end").alias("b"))
    d = audit.agg(F.count_if(F.col("row_rule") == "SESSION-START").alias("c"), F.count_if(F.col("row_rule") == "SESSION-END").alias("d"))
    covered = t.join(d, F.lit(True)).select(F.lit("sessions_covered").alias("check"), ((F.col("a") != F.col("c")) | (F.col("b") != F.col("d"))).cast("long").alias("n"))
    enqueued = trace.where(kind == "confirm_enqueued").groupBy("request_id").agg(F.first("audit_id").alias("enq_audit"), F.first("rule_id").alias("enq_rule"), F.lit(True).alias("enqueued"))
    shown = trace.where(kind == "confirm_shown").select("request_id", F.lit(True).alias("shown")).distinct()
    solved = trace.where((kind == "confirm_resolved") & (F.col("outcome") == "resolved")).select("ts", "request_id", "audit_id", "approve")
    solved = solved.join(enqueued, "request_id", "left").join(shown, "request_id", "left").withColumn("aid", F.when(F.col("enqueued"), F.coalesce("audit_id", "enq_audit")))
    solved = solved.join(audit.withColumn("there", F.lit(True)), "aid", "left")
    want = F.when(F.coalesce("approve", F.lit(False)), "approve").otherwise("deny")
    wrong = (
        F.col("request_id").isNull() | F.col("shown").isNull() | F.col("enqueued").isNull() | F.col("aid").isNull() | F.col("there").isNull()
        | ~want.eqNullSafe(F.col("user_decision")) | (F.col("enq_rule").isNotNull() & (F.col("enq_rule") != F.col("row_rule")))
    )
    unmatched = audit.where(F.col("user_decision").isin("approve", "deny")).join(solved.where("aid is not null").select("aid").distinct(), "aid", "left_anti").agg(F.count("*").alias("m"))
    receipts = solved.agg(F.count_if(wrong).alias("k")).join(unmatched, F.lit(True)).select(F.lit("receipts_match").alias("check"), (F.col("k") + F.col("m")).alias("n"))
    expired = trace.where(kind == "confirm_expired").select(F.col("audit_id").alias("aid")).join(audit, "aid", "left")
    timeouts = expired.agg(F.count_if(~F.lit("timeout").eqNullSafe(F.col("user_decision"))).alias("n")).select(F.lit("timeouts_receipted").alias("check"), "n")
    closed = closed_intervals(trace)
    seen = audit.where(F.col("event_type").isin(*OBSERVATIONS)).select(F.col("timestamp_ms").alias("ts")).unionByName(trace.where((kind == "observe_tick") & (F.col("events") > 0)).select("ts"))
    late = inside(seen, closed, "ts").agg(F.count("*").alias("n")).select(F.lit("nothing_after_end").alias("check"), "n")
    active = trace.where((kind == "state") & (F.col("protection_state") == "active")).select("ts")
    held = backed(active, trace.where(kind == "observe_tick").select("ts")).agg(F.count_if(~F.col("backed")).alias("k"))
    shut = inside(active, closed, "ts").agg(F.count("*").alias("m"))
    state = held.join(shut, F.lit(True)).select(F.lit("active_backed").alias("check"), (F.col("k") + F.col("m")).alias("n"))
    stale = trace.where((kind == "confirm_resolved") & (F.col("outcome") == "stale") & F.col("approve")).select(F.col("audit_id").alias("aid")).join(audit.where("user_decision = 'approve'"), "aid", "left_semi")
    stale = stale.agg(F.count("*").alias("n")).select(F.lit("stale_never_approves").alias("check"), "n")
    return union_all(covered, receipts, timeouts, late, state, stale).select("check", (F.col("n") == 0).alias("pass"), F.col("n").alias("problems"))


def execution_view(rows: DataFrame) -> DataFrame:
    """One row for each action of an execution log (id with '/decision', '' or '/result' behind it, rowid, event_type, action,
    dispatched): classification and state, newest first; valid tells whether its stages are in order."""
    stage = F.when(F.col("event_type") == "GatewayDecision", "decision").when(F.col("event_type") == "GatewayExecutionStarted", "started").when(F.col("event_type") == "GatewayExecutionFinished", "finished")
    one = rows.withColumn("stage", stage).where("stage is not null").withColumn("action_id", F.regexp_replace("id", "/(decision|result)$", ""))
    of = lambda s, c: F.max_by(c, F.when(F.col("stage") == s, F.col("rowid")))
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("rowid")))
    out = one.groupBy("action_id").agg(
        *[at(s).alias(s) for s in ("decision", "started", "finished")], F.count("*").alias("n"),
        F.max_by("action", F.when(F.col("stage") == "decision", F.col("rowid"))).alias("verdict"), F.max_by("action", F.when(F.col("stage") == "finished", F.col("rowid"))).alias("outcome"), F.max_by("dispatched", F.when(F.col("stage") == "finished", F.col("rowid"))).alias("sent"), F.max("rowid").alias("last"),
    )
    has = lambda c: F.col(c).isNotNull()
    stages = sum((has(s).cast("int") for s in ("decision", "started", "finished")), F.lit(0))
    ordered = F.coalesce(F.col("decision") < F.coalesce("started", "finished"), F.lit(True)) & F.coalesce(F.col("started") < F.col("finished"), F.lit(True)) & (F.col("n") == stages) & ~(has("started") & F.coalesce(F.col("verdict") == "refuse", F.lit(False)))
    o, sent = F.col("outcome"), F.col("sent")
    state = (
        F.when(~has("decision") & ~has("started"), "terminal_without_prior")
        .when((o == "refused") & ~sent, "refused_before_dispatch").when((o == "success") & sent, "tool_returned_effects_unknown").when((o == "cancelled") & ~sent, "cancelled_before_dispatch").when((o == "failed") & ~sent, "failed_before_dispatch")
        .when(has("finished"), F.concat(o, F.lit("_effects_unknown"))).when(has("started"), "started_without_result").when(F.col("verdict") == "refuse", "refused").when(F.col("verdict") == "needs_confirmation", "waiting").otherwise("decided_not_started")
    )
    kind = F.when(~ordered, "unknown").when(F.col("state").isin("refused_before_dispatch", "refused", "cancelled_before_dispatch"), "blocked").when(F.col("state") == "tool_returned_effects_unknown", "record").when(F.col("state") == "waiting", "waiting").otherwise("unknown")
    return out.withColumn("state", state).select("action_id", kind.alias("classification"), "state", ordered.alias("valid"), "last").orderBy(F.desc("last"))


def diff_files(baseline: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, change) of two sets of (path, sha256): added, modified or deleted."""
    b, s = baseline.select("path", F.col("sha256").alias("old")), snapshot.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return b.join(s, "path", "full").select("path", change.alias("change")).where("change is not null")


def diff_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(line, change) of two sets of lines (column value) without comments, white space collapsed."""
    clean = lambda d: d.select(F.trim(F.regexp_replace("value", "\\s+", " ")).alias("line")).where("line <> '' and not startswith(line, '#')").distinct()
    a, b = clean(old), clean(new)
    return union_all(b.join(a, "line", "left_anti").withColumn("change", F.lit("added")), a.join(b, "line", "left_anti").withColumn("change", F.lit("removed")))


def narrow(ceiling: Column, requested: Column, match) -> tuple[Column, Column]:
    """(granted, refused) of a request under a ceiling, both arrays; match(requested entry, ceiling entry).

    Without a ceiling (null) nothing is constrained and the request doesn't matter; without a request the ceiling is granted; an empty request gets nothing.
    """
    granted = F.filter(ceiling, lambda c: F.exists(requested, lambda r: match(r, c)))
    refused = F.filter(requested, lambda r: ~F.exists(ceiling, lambda c: match(r, c)))
    none = F.array().cast("array<string>")
    return F.when(ceiling.isNotNull(), dedupe(F.when(requested.isNull(), ceiling).otherwise(granted))), F.when(ceiling.isNotNull() & requested.isNotNull(), dedupe(refused)).otherwise(none)


def dedupe(values: Column) -> Column:
    """Values without later ones that equal an earlier one but for case and outer white space; blank ones go."""
    rows = F.filter(values, lambda v: F.trim(v) != "")
    return F.filter(rows, lambda v, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda u: F.lower(F.trim(u)) == F.lower(F.trim(v))))


def intersect_permissions(a: Column, b: Column) -> Column:
    """What two lists of permissions have in common, in the order of the first. Null stands for everything, empty for nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.filter(a, lambda x: F.array_contains(b, x)))


#: Probes of a suite, which is configuration, at most.
MAX_PROBES = 10_000


def comparability(profiles: DataFrame, suite: DataFrame) -> DataFrame:
    """Problems (agent_id, probe_id, problem) of answers (agent_id, probe_id, dimension) against a suite (probe_id, dimension): probes it doesn't have or has under
    another dimension, those that an agent leaves out, and agents that answer a probe twice."""
    wanted = {r["probe_id"]: r["dimension"] for r in suite.select("probe_id", "dimension").limit(MAX_PROBES + 1).collect()}
    if len(wanted) > MAX_PROBES:
        raise ValueError(f"a suite has at most {MAX_PROBES} probes")
    none = F.lit(None).cast("string")
    dimension = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col("probe_id")] if wanted else none
    answers = profiles.groupBy("agent_id", "probe_id").agg(F.first("dimension").alias("dimension"), F.count("*").alias("n")).withColumn("wanted", dimension)
    problem = F.when(F.col("wanted").isNull(), "unknown_probe").when(F.col("wanted") != F.col("dimension"), "wrong_dimension")
    wrong = answers.select("agent_id", "probe_id", problem.alias("problem")).where("problem is not null")
    again = answers.where("n > 1").select("agent_id", "probe_id", F.lit("duplicate_answer").alias("problem"))
    every = F.array(*map(F.lit, wanted)).cast("array<string>")
    left = answers.groupBy("agent_id").agg(F.collect_set("probe_id").alias("have")).select("agent_id", F.explode(F.array_except(every, "have")).alias("probe_id"), F.lit("missing_probe").alias("problem"))
    return union_all(wrong, again, left)


def nearest_label(observed: DataFrame, registry: DataFrame, fold, variants) -> DataFrame:
    """(id, app_id, match) of observed labels (id, app_id, label) that equal a registered one (app_id, label) of another app when folded, or are one typo away."""
    o = observed.select("id", F.col("app_id").alias("own"), fold(F.col("label")).alias("f"))
    keys = registry.select("app_id", fold(F.col("label")).alias("k"))
    typos = keys.select("app_id", F.explode(variants(F.col("k"))).alias("f"), F.lit("typo").alias("match"))
    exact = keys.select("app_id", F.col("k").alias("f"), F.lit("exact").alias("match"))
    met = o.join(exact.unionByName(typos), "f").where(~F.col("own").eqNullSafe(F.col("app_id")))
    return met.groupBy("id", "app_id").agg(F.min("match").alias("match"))


def near_hashes(observed: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """(id, key, distance) of observed 64-bit hashes (id, h) and known ones (key, h) that differ in `most` bits at most.

    Multi-index hashing: two such hashes agree in one of most + 1 bands of their bits, so bands are joined by equality and what meets is counted out. Equal hashes
    count as one on either side until the end, so copies don't make bands large. Null hashes match nothing.
    """
    cuts = [64 * i // (most + 1) for i in range(most + 2)]

    def band(a: int, b: int) -> Column:
        return F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))

    def banded(df: DataFrame, to: str) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(i).alias("i"), band(a, b).cast("long").alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
        return df.select("h").where("h is not null").distinct().select(F.col("h").alias(to), F.explode(bands).alias("b")).select(to, "b.i", "b.v")

    met = banded(observed, "x").join(banded(known, "y"), ["i", "v"]).select("x", "y").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most).distinct()
    out = observed.select("id", F.col("h").alias("x")).join(met, "x").join(known.select("key", F.col("h").alias("y")), "y")
    return out.select("id", "key", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))


def nearest_hash(observed: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """(id, key, distance) of the nearest known hash of each observed one, the smallest key of equally near ones; those with none nearer than `most` bits are left out."""
    best = near_hashes(observed, known, most).groupBy("id").agg(F.min(F.struct("distance", "key")).alias("b"))
    return best.select("id", "b.key", "b.distance")


def manifest_changes(rows: DataFrame, service: str = "service", order: str = "rowid") -> DataFrame:
    """Registry rows (service, rowid, digest, state) with changed (a digest unlike the one before) and legal (an allowed change of state)."""
    by = Window.partitionBy(service).orderBy(order)
    was = F.lag("state").over(by)
    ok = F.when(was.isNull(), F.col("state") == "pending").when(was == "pending", F.col("state").isin("approved", "denied", "pending")).when(was == "approved", F.col("state").isin("pending", "revoked")).otherwise(F.col("state") == "pending")
    return rows.withColumn("changed", F.coalesce(F.lag("digest").over(by) != F.col("digest"), F.lit(False))).withColumn("legal", ok)


def recovered(rows: DataFrame, started: str = "EgressDispatchStarted", finished: str = "EgressDispatchFinished") -> DataFrame:
    """rows and, for each dispatch without an end, a made-up end with action 'unknown'."""
    from tidemark.operators.audit import started_without_result

    lost = started_without_result(rows, started, finished).withColumns({"id": F.concat("id", F.lit("/result")), "event_type": F.lit(finished), "action": F.lit("unknown")})
    return rows.unionByName(lost)


def merge_blocklist(persistent: DataFrame, session: DataFrame, now_ms: int, cap: int = 4000, ttl_ms: int = 1_800_000) -> DataFrame:
    """(host, kind, expires_ms) of persistent hosts (host, added_ms), the newest cap of them, and session hosts (host, seen_ms) until ttl_ms behind
    their last sight, where they aren't persistent."""
    kept = persistent.groupBy("host").agg(F.max("added_ms").alias("added_ms")).orderBy(F.desc("added_ms"), "host").limit(cap).select("host", F.lit("persistent").alias("kind"), F.lit(None).cast("long").alias("expires_ms"))
    live = session.groupBy("host").agg((F.max("seen_ms") + ttl_ms).alias("expires_ms")).where(F.col("expires_ms") > now_ms)
    return kept.unionByName(live.join(kept, "host", "left_anti").select("host", F.lit("session").alias("kind"), "expires_ms"))
