"""Versioned stores as append-only rows: tool registry, memory entries, sources, and audit rows made from events and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import entities, text
from tidemark.operators.scale import in_order
from tidemark.operators.sessions import latest

SCANNED = ("ui_text", "uri", "url", "clipboard_text", "ocr_text")


def camel(c: Column) -> Column:
    """snake_case as CamelCase, which is how audit rows name types and actions."""
    return F.array_join(F.transform(F.split(c, "_"), lambda p: F.initcap(p)), "")


def session_digest(session: Column) -> Column:
    """A session's pseudonym."""
    return F.concat(F.lit("session-sha256:"), F.sha2(session, 256))


def redact_metadata(metadata: Column) -> Column:
    """Metadata with sensitive runs masked in the scanned fields that hold a verified entity."""
    return F.transform_values(metadata, lambda k, v: F.when(k.isin(*SCANNED) & entities.has_verified(entities.recognise(v)), entities.mask_runs(v)).otherwise(v))


def defuse_agent_tag(message: Column) -> Column:
    """A forged attribution in a message is only a claim."""
    return F.replace(message, F.lit("[agent: "), F.lit("[claimed-agent: "))


def content_scan(metadata: Column) -> Column:
    """Struct of the entities, anomalies and breakouts in the scanned fields, each kind once."""
    values = F.array_compact(F.array(*[metadata[k] for k in SCANNED]))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(values, entities.recognise))))
    odd = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(values, text.scan_anomalies)), lambda a: a["kind"])))
    out = F.array_sort(F.array_distinct(F.array_compact(F.transform(values, lambda v: text.detect_breakout(v)))))
    return F.struct(found.alias("entities"), odd.alias("anomalies"), out.alias("breakouts"))


def audit_rows(decided: DataFrame, log_id: str = "log_id", rowid: str = "rowid") -> DataFrame:
    """Audit rows of events with their decisions: pseudonymous sessions, masked metadata, messages without forged tags."""
    d = F.col("decision")
    return decided.select(
        log_id, rowid, F.col("event_id").alias("id"), "timestamp_ms", "platform", camel(F.col("event_type")).alias("event_type"), "source_app", session_digest(F.col("agent_context_id")).alias("agent_session_id"), d["rule_id"].alias("rule_id"), camel(d["severity"]).alias("severity"), camel(d["action"]).alias("action"),
        defuse_agent_tag(d["human_message"]).alias("human_message"), F.lit(None).cast("string").alias("evidence_ref"), F.to_json(redact_metadata(F.col("metadata"))).alias("event_json"), F.lit(None).cast("string").alias("user_decision"), F.lit(None).cast("string").alias("attributed_agent"),
    )


def prepare(entries: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new versions, conflicts) of drafts (item_key, expected_version, content, label) over entries (item_key, version, content, label, state):
    the next version with the higher label where the expected version is the latest one, else a conflict."""
    now = latest(entries, "item_key", "version").select("item_key", F.col("version").alias("now"), F.col("label").alias("was"))
    both = drafts.join(now, "item_key", "left")
    ok = F.coalesce("now", F.lit(0)) == F.coalesce("expected_version", F.lit(0))
    new = both.where(ok).select("item_key", (F.coalesce("now", F.lit(0)) + 1).alias("version"), "content", F.greatest("label", "was").alias("label"), F.lit("active").alias("state"))
    return new, both.where(~ok).select("item_key", "expected_version", F.col("now").alias("latest_version"))


def change_state(entries: DataFrame, keys: DataFrame, state: str) -> DataFrame:
    """New versions of the latest entries of some keys with another state (revoked, quarantined)."""
    return latest(entries, "item_key", "version").join(keys.select("item_key"), "item_key", "left_semi").withColumns({"version": F.col("version") + 1, "state": F.lit(state)})


def restore(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """New versions copied from older ones (item_key, version), active again, with the highest label the key ever had."""
    top = entries.groupBy("item_key").agg(F.max("version").alias("now"), F.max("label").alias("most"))
    return entries.join(wanted, ["item_key", "version"], "left_semi").join(top, "item_key").withColumns({"version": F.col("now") + 1, "label": F.col("most"), "state": F.lit("active")}).drop("now", "most")


def preserves(old: Column, new: Column) -> Column:
    """Whether a draft (struct scope, item_key, label, sources) keeps scope, key, label and all sources of another."""
    return (old["scope"] == new["scope"]) & (old["item_key"] == new["item_key"]) & (new["label"] >= old["label"]) & (F.size(F.array_except(old["sources"], new["sources"])) == 0)


def published(rows: DataFrame, service: str = "service") -> DataFrame:
    """Approved tools of the latest registry rows (service, rowid, state, digest, tools) with their aliases."""
    now = latest(rows, service, "rowid").where("state = 'approved'")
    return now.select(service, "digest", F.explode("tools").alias("tool")).withColumn("alias", F.concat_ws("__", service, "tool"))


def decide_registrations(rows: DataFrame, replies: DataFrame, now_ms: int, service: str = "service") -> DataFrame:
    """Replies (review_id, nonce, digest, approve) to pending rows (service, rowid, state, review_id, nonce, digest, expires_ms): approved, denied,
    expired, or rejected where nonce or digest differ or nothing is pending."""
    pending = latest(rows, service, "rowid").where("state = 'pending'").select(service, "review_id", F.col("nonce").alias("want_nonce"), F.col("digest").alias("want_digest"), "expires_ms")
    met = replies.join(pending, "review_id", "left")
    same = (F.col("nonce") == F.col("want_nonce")) & (F.col("digest") == F.col("want_digest"))
    outcome = F.when(F.col(service).isNull() | ~same, "rejected").when(F.col("expires_ms") <= now_ms, "expired").when(F.col("approve"), "approved").otherwise("denied")
    return met.select("review_id", service, outcome.alias("outcome"))


def import_sources(old: DataFrame, current: DataFrame, binding: str) -> DataFrame:
    """Rows of an older log that the current one doesn't have, each bound to the log it came from."""
    return old.join(current.select("id"), "id", "left_anti").withColumn("bound_to", F.lit(binding))


def resolve_technique(rows: DataFrame, migrations: DataFrame, version: str = "version", technique: str = "technique") -> DataFrame:
    """rows with current, the id that a technique of an older catalog version has now (migrations: version, old_id, new_id)."""
    m = migrations.select(F.col("version").alias(version), F.col("old_id").alias(technique), "new_id")
    return rows.join(m, [version, technique], "left").withColumn("current", F.coalesce("new_id", technique)).drop("new_id")


def catalog_summary(techniques: DataFrame) -> DataFrame:
    """Techniques by evidence and status."""
    return techniques.groupBy("evidence", "status").agg(F.count("*").alias("n"))


class _Room:
    """What is left of each node below one root. Limits come before requests."""

    def __init__(self):
        self.left: dict[str, int] = {}

    def step(self, side, node, path, amount):
        if side == 0:
            self.left[node] = amount
            return (None,)
        ok = amount is not None and all(self.left.get(n, 0) >= amount for n in path)
        for n in path if ok else ():
            self.left[n] -= amount
        return (ok,)


def reserve(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests (node, rowid, amount) with granted: node and all its ancestors had room for the amount, given all that was granted before.

    limits: node, path (array of the node and its ancestors), limit. Requests of one root depend on each other, so each root's are folded in order of rowid behind its
    limits; the state is a number for each node of the root, however many requests there are. Requests for nodes without limit are left out.
    """
    root = F.element_at("path", -1).alias("root")
    most = limits.select(root, F.lit(0).alias("__side"), "node", "path", F.lit(None).cast("long").alias("rowid"), F.col("limit").cast("long").alias("amount"))
    asked = requests.join(limits.select("node", "path"), "node").select(root, F.lit(1).alias("__side"), "node", "path", F.col("rowid").cast("long").alias("rowid"), F.col("amount").cast("long").alias("amount"))
    rows = in_order(most.unionByName(asked), ["root"], ["__side", "rowid"], ["__side", "node", "path", "amount"], _Room, {"granted": "boolean"})
    return rows.where("__side = 1").select("node", "rowid", "amount", "granted")


def env_guard(events: DataFrame, session: str = "session", order: str = "rowid") -> DataFrame:
    """events with guarded: a high-tier value is filled while the session's last survey saw another app observe input."""
    seen = F.last(F.when(F.col("event_type") == "environment_survey", F.size("observers") > 0), ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("guarded", F.coalesce((F.col("event_type") == "form_fill") & F.col("high") & seen, F.lit(False)))


def content_views(captures: DataFrame) -> DataFrame:
    """captures (id, origin, raw: binary, complete, visible) with digest, bytes, utf8_valid, state and the views that detection reads; a stream equal to
    what is visible isn't read twice."""
    decoded = F.try_validate_utf8(F.col("raw").cast("string"))
    state = F.when(decoded.isNull() & F.col("complete"), "unsupported_encoding").when(~F.col("complete"), "truncated").otherwise("complete")
    shown = F.make_valid_utf8(F.col("raw").cast("string"))
    views = F.slice(F.array_distinct(F.concat(text.matching_views(shown), F.when(shown == F.col("visible"), F.array().cast("array<string>")).otherwise(text.matching_views(F.col("visible"))))), 1, 64)
    return captures.select("id", "origin", F.sha2("raw", 256).alias("sha256"), F.octet_length("raw").alias("bytes"), decoded.isNotNull().alias("utf8_valid"), state.alias("state"), views.alias("views"))


def bindings(rows: DataFrame, service: str = "service") -> DataFrame:
    """(service, tool, digest) of every tool of a service whose latest registry row (service, rowid, state, digest, tools) is approved."""
    now = latest(rows, service, "rowid").where("state = 'approved'")
    return now.select(service, F.explode("tools").alias("tool"), "digest")


def verify_bindings(held: DataFrame, rows: DataFrame, service: str = "service") -> DataFrame:
    """held bindings (service, tool, digest) with state: 'ok', 'changed' where the registered manifest is another one by now, or 'gone'."""
    now = bindings(rows, service).withColumnRenamed("digest", "now")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("digest"), "changed").otherwise("ok")
    return held.join(now, [service, "tool"], "left").withColumn("state", state).drop("now")


def observed(sources: DataFrame, new: DataFrame, id_col: str = "source_id") -> DataFrame:
    """sources with those rows of new whose id isn't there yet; of several with one id the first by rowid."""
    first = new.groupBy(id_col).agg(F.min_by(F.struct("*"), "rowid").alias("r")).select("r.*")
    return sources.unionByName(first.join(sources.select(id_col), id_col, "left_anti").select(sources.columns))


def ingress_counts(rows: DataFrame, adapter: str = "adapter_id") -> DataFrame:
    """How many events of each adapter came verified, unsigned and rejected (column outcome)."""
    return rows.groupBy(adapter).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("verified", "unsigned", "rejected")])
