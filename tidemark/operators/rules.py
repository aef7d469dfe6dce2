"""Rule matching and decisions as one projection.

A rule set is configuration of a few dozen rows. It becomes a fixed expression, so matching scans each text once and neither
joins nor shuffles; larger lists (domains, labels) are joined by key instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hosts import LARGE_UPLOAD, bare_host, suffixes
from tidemark.functions.text import bind, matching_views
from tidemark.schemas import DECISION, LOW_KEYS, SEVERITIES, action_rank, severity_rank, step_gravity

FLOW_KINDS = {"network": "network_egress", "shell_arg": "run_shell", "critical_action": "confirm_payment", "memory": "persist_memory"}
EVENT_KINDS = {
    "permission_request": "request_permission", "deeplink": "app_switch", "memory_write": "persist_memory", "memory_read": "recall_memory",
    "network_flow": "network_egress", "process_exec": "run_shell",
}


def match_length(views: Column, patterns: Sequence[str]) -> Column:
    """Characters of the longest pattern that a view contains, ignoring case; null if none does."""

    def hit(p: str) -> Column:
        return F.when(F.exists(views, lambda v: v.contains(p)), len(p))

    none = F.lit(None).cast("int")
    return F.greatest(none, none, *[hit(p.lower()) for p in patterns])


def rule_text_matches(text: Column, patterns: Sequence[str]) -> Column:
    return bind(F.transform(matching_views(text), F.lower), lambda v: match_length(v, patterns).isNotNull())


def _applies(rule: dict, event_type: Column, platform: Column) -> Column:
    ok = F.lit(True)
    if rule.get("event_types"):
        ok = ok & event_type.isin(rule["event_types"])
    if rule.get("platforms"):
        p = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
        ok = ok & ((p == "") | p.isin([x.strip().lower() for x in rule["platforms"]]))
    return ok


def most_specific_rule(text: Column, event_type: Column, platform: Column, rules: Sequence[dict], excluded: Sequence[str] = ()) -> Column:
    """The matching rule of the greatest (is a block, asks for confirmation, match length); of equals the last in the rule set. Null if none matches."""

    def of(views: Column) -> Column:
        found = []
        for i, r in enumerate(rules):
            if r["id"] in excluded or not r.get("match_any_text"):
                continue
            n = match_length(views, r["match_any_text"])
            row = F.struct(
                F.lit(int(r["action"] == "block")).alias("block"), F.lit(int(bool(r.get("require_confirm")))).alias("confirm"), n.alias("length"), F.lit(i).alias("position"),
                F.lit(r["action"]).alias("action"), F.lit(r["severity"]).alias("severity"), F.lit(r["id"]).alias("rule_id"), F.lit(r.get("description") or f"Matched rule {r['name']}").alias("human_message"), F.lit(bool(r.get("require_confirm"))).alias("require_confirm"),
            )
            found.append(F.when(n.isNotNull() & _applies(r, event_type, platform), row))
        return F.array_max(F.array_compact(F.array(*found)))

    return bind(F.transform(matching_views(text), F.lower), of)


def decision(action, severity, rule_id, message, confirm=False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(action).alias("action"), lit(severity).alias("severity"), lit(rule_id).alias("rule_id"), lit(message).alias("human_message"), lit(confirm).alias("require_confirm"))


def no_decision() -> Column:
    return F.lit(None).cast(f"struct<{DECISION.replace(' ', ':').replace(',:', ',')}>")


ALLOW = ("allow", "info", "ALLOW", "")


def from_mode(mode: str, rule_id: str, message, severity: str) -> Column:
    """A contract's mode as a decision: deny, block, ask and require_confirm block with confirmation, alert alerts, allow allows."""
    if mode == "allow":
        return decision("allow", severity, rule_id, message)
    if mode == "alert":
        return decision("alert", severity, rule_id, message)
    return decision("block", severity, rule_id, message, True)


def is_worse(b: Column, a: Column) -> Column:
    """Whether decision b outranks a; equals don't."""
    rank = lambda d: action_rank(d["action"]) * 10 + severity_rank(d["severity"])
    return rank(b) > rank(a)


def worse_of(a: Column, b: Column) -> Column:
    """The worse of two decisions by action, then severity; the first of equals, and the other one where one is null."""
    return F.when(b.isNull(), a).when(a.isNull(), b).when(is_worse(b, a), b).otherwise(a)


def merge_keeping_reason(primary: Column, extra: Column) -> Column:
    """The worse decision, with rule and message of the other one appended if they aren't there yet."""

    def of(s: Column) -> Column:
        w = F.when(is_worse(s["b"], s["a"]), s["b"]).otherwise(s["a"])
        lost = F.when(w["rule_id"] == s["b"]["rule_id"], s["a"]).otherwise(s["b"])
        more = (lost["human_message"] != "") & ~w["human_message"].contains(lost["human_message"])
        said = F.when(more, F.concat(w["human_message"], F.lit(" ["), lost["rule_id"], F.lit(": "), lost["human_message"], F.lit("]"))).otherwise(w["human_message"])
        return decision(w["action"], w["severity"], w["rule_id"], said, w["require_confirm"])

    return F.when(extra.isNull(), primary).when(primary.isNull(), extra).otherwise(bind(F.struct(primary.alias("a"), extra.alias("b")), of))


def constrain_with_package(primary: Column, extra: Column) -> Column:
    """A rule package can only tighten: a plain allow changes nothing, and a block without confirmation stays one."""
    hard = ((primary["action"] == "block") & ~primary["require_confirm"]) | ((extra["action"] == "block") & ~extra["require_confirm"])
    confirm = ~hard & (primary["require_confirm"] | extra["require_confirm"])
    m = merge_keeping_reason(primary, extra)
    made = bind(m, lambda d: decision(d["action"], d["severity"], d["rule_id"], d["human_message"], confirm))
    return F.when((extra["action"] == "allow") & ~extra["require_confirm"], primary).otherwise(made)


def device_policy(d: Column, agent: Column, allowed_agents: Sequence[str] = (), block_domains: bool = False, confirm_critical: bool = False, policy: str = "policy") -> Column:
    """A device's policy over a decision, which can only tighten it: agents that aren't listed (if any are) are blocked, malicious domains too, and critical
    decisions that aren't plain permissions need a confirmation. Without a session (null agent) the list says nothing."""
    out = d
    if block_domains:
        hit = (out["rule_id"] == "INTEL-DOMAIN") & out["action"].isin("alert", "log_only")
        out = F.when(hit, decision("block", out["severity"], out["rule_id"], F.concat(out["human_message"], F.lit(" [policy: block_malicious_domains]")), out["require_confirm"])).otherwise(out)
    if confirm_critical:
        hit = (out["severity"] == "critical") & (out["action"] != "allow") & ~out["require_confirm"]
        out = F.when(hit, decision(out["action"], out["severity"], out["rule_id"], F.concat(out["human_message"], F.lit(" [policy: require_confirm_critical]")), True)).otherwise(out)
    if allowed_agents:
        listed = F.lower(F.trim(agent)).isin([a.lower() for a in allowed_agents])
        said = F.concat(F.lit("agent '"), agent, F.lit(f"' is not in device policy {policy} allowed_agents [{', '.join(allowed_agents)}]"))
        out = F.when(agent.isNotNull() & ~listed, decision("block", "high", "POLICY-AGENT-NOT-ALLOWED", said)).otherwise(out)
    return out


def worst_severity(findings: Column) -> Column:
    """The highest severity among findings (structs with a field severity); null for none."""
    top = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return F.get(F.array(*map(F.lit, SEVERITIES)), top)


def step_kind(event_type: Column, metadata: Column, rules: Sequence[dict], high_keys: Sequence[str], low_keys: Sequence[str] = LOW_KEYS) -> Column:
    """The kind of step an event is: the gravest kind that a rule's text declares, of equals the last, else by event type. Unknown keys count as high."""
    declared = F.lit(None).cast("struct<gravity:int,position:int,kind:string>")
    text = metadata["ui_text"]

    def of(views: Column) -> Column:
        kinds = []
        for i, r in enumerate(rules):
            if r.get("step_kind"):
                ok = match_length(views, r["match_any_text"]).isNotNull() & (event_type.isin(r["event_types"]) if r.get("event_types") else F.lit(True))
                kinds.append(F.when(ok, F.struct(step_gravity(F.lit(r["step_kind"])).alias("gravity"), F.lit(i).alias("position"), F.lit(r["step_kind"]).alias("kind"))))
        return F.array_max(F.array_compact(F.array(*kinds)))

    if any(r.get("step_kind") for r in rules):
        declared = F.when(text.isNotNull(), bind(F.transform(matching_views(text), F.lower), of))
    known = list(low_keys)
    fill = F.when(F.coalesce(metadata["value_filled"], F.lit("")) != "true", "observe").when(metadata["profile_key"].isin(known) & ~metadata["profile_key"].isin(list(high_keys)), "disclose_low").otherwise("disclose_high")
    flow = F.lit("observe")
    for k, v in FLOW_KINDS.items():
        flow = F.when(metadata["sink_kind"] == k, v).otherwise(flow)
    base = F.when(event_type == "form_fill", fill).when(event_type == "data_flow", flow)
    for k, v in EVENT_KINDS.items():
        base = base.when(event_type == k, v)
    base = base.when(event_type.isin("agent_session_start", "agent_session_end"), F.lit(None).cast("string")).otherwise("observe")
    return F.coalesce(declared["kind"], base)


def contains_any(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Whether a text contains one of some patterns: injection patterns ignore case, deep links don't."""
    t = F.lower(text) if ignore_case else text
    return reduce(lambda a, p: a | t.contains(p.lower() if ignore_case else p), patterns, F.lit(False))


def malicious_hosts(rows: DataFrame, host: Column, domains: DataFrame, into: str = "malicious_domain") -> DataFrame:
    """rows with the longest listed domain that host is or is below; null if none. The distinct hosts meet the list once, by an equal join on their
    suffixes, and the rows meet what was found by their host. Rows that repeat stay. Rows without host, most of a log, get keys of their own
    that match nothing, so they don't meet in one task."""
    listed = domains.select(F.lower("domain").alias("__domain")).distinct()
    keyed = rows.select(F.lower(host).alias("__host")).where("__host is not null").distinct().select("__host", F.explode(suffixes(F.col("__host"))).alias("__domain"))
    best = F.max(F.struct(F.length("__domain").alias("n"), F.col("__domain").alias("domain")))
    found = keyed.join(listed, "__domain").groupBy("__host").agg(best["domain"].alias(into))
    nowhere = F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))
    return rows.withColumn("__host", F.coalesce(F.lower(host), nowhere)).join(found, "__host", "left").drop("__host")


def evaluate_flow(malicious_domain: Column, host: Column, bytes_out: Column) -> Column:
    """Network flows: a malicious host first, then a large upload, else allowed."""
    h = F.lower(host)
    large = F.concat(F.lit("Large upload "), bytes_out.cast("string"), F.lit(" bytes to "), h)
    return F.when(malicious_domain.isNotNull(), decision("block", "critical", "INTEL-DOMAIN", F.concat(F.lit("Suspicious egress host: "), h), True)).when(bytes_out >= LARGE_UPLOAD, decision("alert", "high", "PRIV-005", large)).otherwise(decision(*ALLOW))


def revalidate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (event_id, decision) of events whose (event_type, source_app, ui_text) differ between decision and execution."""
    mark = lambda d: d.select("event_id", F.struct("event_type", "source_app", F.col("metadata")["ui_text"].alias("t")).alias("m"))
    b, a = mark(before).withColumnRenamed("m", "was"), mark(after).withColumnRenamed("m", "now")
    return b.join(a, "event_id").where(~F.col("was").eqNullSafe(F.col("now"))).select("event_id", decision("block", "high", "UI-REVALIDATE", "UI changed between decision and execution", True).alias("decision"))


