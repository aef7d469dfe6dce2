"""The decision on every event of a session: stateless findings as columns, session state as a fold over them, both merged in a fixed order.

`prepared` computes everything that an event tells by itself (matching rule, threat patterns, malicious host, text scan, paths, hosts, identity, deep link)
with built-in expressions, so texts are read by Spark and never by the fold. `decide_sessions` then runs each session's rows in order through `Session`, which
holds what the session has granted, filled, saved, derived and done so far, and nothing of the rows themselves; it grows with the session's keys, apps and value ids.
`streaming/sessions.py` does the same on streams of events and replies.
"""

from __future__ import annotations

import functools
from collections import namedtuple
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fields, hosts, paths
from tidemark.functions import text as texts
from tidemark.operators import frames
from tidemark.operators import rules as rule_ops
from tidemark.operators.registry import SCANNED, content_scan
from tidemark.operators.scale import dealt, folded
from tidemark.operators.taint import HIGH, LOW, PUBLIC, TAINTED, VERIFIED, Lattice
from tidemark.operators.trajectory import OBSERVATIONS, Plan
from tidemark.schemas import ACTIONS, HIGH_KEYS, LOW_KEYS, SEVERITIES

#: How strict a contract is where it says nothing.
MODES = {
    "on_high_access": "require_confirm", "on_optional_pii_fill": "alert", "on_trap_widget_fill": "block", "on_memory_write": "require_confirm", "on_no_write_down": "require_confirm", "on_confidentiality_downgrade": "require_confirm",
    "on_unlabelled_flow": "require_confirm", "on_plan_drift": "alert", "on_context_breakout": "alert", "on_text_anomaly": "alert", "on_generated_pii_fill": "alert",
}
BAD, GUARDED = "Malicious domain blocked: ", ("form_fill", "deeplink", "permission_request")


@dataclass(frozen=True)
class Config:
    """What an operator lays down: rules, threat patterns, key tiers, modes, task plans and known apps (name, packages, signers, deeplink_prefixes)."""

    rules: Sequence[dict] = ()
    injections: Sequence[str] = ()
    deeplinks: Sequence[str] = ()
    low_keys: Sequence[str] = LOW_KEYS
    high_keys: Sequence[str] = HIGH_KEYS
    modes: dict = field(default_factory=dict)
    plans: dict[str, Plan] | None = None
    require_plan: bool = False
    apps: Sequence[dict] = ()
    require_attestation: bool = False
    home: str = "/home/user"
    cwd: str = "/work"

    def mode(self, name: str) -> str:
        return self.modes.get(name, MODES[name])


def _registered(config: Config, metadata: Column) -> tuple[Column, Column, Column]:
    """(name, identity, deep link rule) of an event's app by its package; the registry is configuration and becomes an expression."""
    name = identity = F.lit(None).cast("string")
    prefixes = F.lit(None).cast("array<string>")
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    package = F.trim(metadata["package"])
    attested = F.split(F.coalesce(metadata["signer_sha256"], F.lit("")), ",")
    for a in config.apps:
        own = package.isin(list(a.get("packages", [])))
        name = F.when(own, a["name"]).otherwise(name)
        identity = F.when(own, fields.identify(F.lit(a["name"]), lit(a.get("packages", [])), lit(a.get("signers", [])), package, attested, F.col("source_app"))).otherwise(identity)
        prefixes = F.when(own, lit(a.get("deeplink_prefixes", []))).otherwise(prefixes)
    by_name = F.lit(None).cast("array<string>")  # without a package the name says which links an app may open, and grants nothing
    for a in config.apps:
        hit = F.lower("source_app").contains(a["name"].lower())
        by_name = F.when(hit & by_name.isNull(), lit(a.get("deeplink_prefixes", []))).otherwise(by_name)
    uri = F.coalesce(metadata["uri"], metadata["ui_text"], F.lit(""))
    rule = fields.decide_deeplink(uri, F.when(package.isNotNull() & (package != ""), prefixes).otherwise(by_name), identity == "verified", config.require_attestation) if config.apps else F.lit("ALLOW")
    return name, F.when(package != "", F.coalesce(identity, F.lit("unregistered"))), rule


def _faces(config: Config, label: Column, icon: Column) -> tuple[Column, Column, Column]:
    """(faces, icon_of, icon_far) of an app's display label and icon hash (16 hex digits): which registered apps it is named like, 'name|exact' or 'name|typo' in order of
    the registry, and whose icon is the nearest that matches, the first of equals. faces is null if neither label nor icon was seen."""
    h = F.when(F.trim(icon).rlike("^[0-9A-Fa-f]{16}$"), F.conv(F.trim(icon), 16, -10).cast("long"))

    def named(f: Column) -> Column:
        hits = []
        for a in config.apps:
            own = [texts.fold_label(F.lit(x)) for x in (a["name"], *a.get("labels", []))]
            exact = functools.reduce(lambda x, y: x | y, [f == k for k in own])
            typo = functools.reduce(lambda x, y: x | y, [F.array_contains(texts.typo_variants(k), f) for k in own])
            hits.append(F.when(exact, f"{a['name']}|exact").when(typo, f"{a['name']}|typo"))
        return F.when(f != "", F.array_compact(F.array(*hits)))

    none = F.array().cast("array<string>")
    known = [(a["name"], int(x, 16) - (1 << 64 if int(x, 16) >> 63 else 0)) for a in config.apps for x in a.get("icon_dhash", [])]
    near = F.array_compact(F.array(*[F.when(frames.icons_match(h, F.lit(k).cast("long")), F.struct(frames.hash_distance(h, F.lit(k).cast("long")).alias("far"), F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, (n, k) in enumerate(known)])) if known else None
    best = F.array_min(near) if known else None
    seen = (F.trim(label) != "") | h.isNotNull()
    faces = F.when(seen, F.coalesce(texts.bind(texts.fold_label(label), named), none)) if config.apps else F.lit(None).cast("array<string>")
    return faces, best["name"] if known else F.lit(None).cast("string"), best["far"] if known else F.lit(None).cast("int")


def prepared(events: DataFrame, config: Config, domains: DataFrame | Sequence[str]) -> DataFrame:
    """events (session, rowid, platform, event_type, source_app, metadata, confirm, trusted) with what each tells by itself. Malicious domains are a frame (domain),
    which is joined unless it has FEW rows, or for streams, which can't be joined that way, a list of some thousands at most."""
    return told(hosted(events, domains), config)


#: A list of up to so many malicious domains becomes part of the expression; a longer one is joined.
FEW = 1000


def hosted(events: DataFrame, domains: DataFrame | Sequence[str]) -> DataFrame:
    """events with malicious_domain, the listed domain that the host of its URL is or is below; null for others."""
    host = hosts.bare_host(F.col("metadata")["url"])
    if isinstance(domains, DataFrame):
        some = domains.select("domain").where("domain is not null").limit(FEW + 1).collect()
        if len(some) > FEW:
            return rule_ops.malicious_hosts(events, host, domains)
        domains = [d["domain"] for d in some]
    known = [d.lower() for d in domains]
    on = F.get(F.filter(hosts.suffixes(host), lambda x: x.isin(known)), F.lit(0)) if known else F.lit(None).cast("string")
    return events.withColumn("malicious_domain", F.when(F.col("metadata")["url"].isNotNull(), on))


def told(rows: DataFrame, config: Config) -> DataFrame:
    """hosted() rows with all else that an event tells by itself. Each check runs behind a look at whether the event has what it reads, as most have little."""
    e, m = F.col("event_type"), F.col("metadata")
    text = m["ui_text"].isNotNull()
    rule = rule_ops.most_specific_rule(m["ui_text"], e, F.col("platform"), config.rules)
    kinds = "struct<action:string,severity:string,rule_id:string,human_message:string,require_confirm:boolean>"
    ruled = F.when(text, texts.bind(rule, lambda r: F.when(r.isNotNull(), rule_ops.decision(r["action"], r["severity"], r["rule_id"], r["human_message"], r["require_confirm"])))) if config.rules else F.lit(None).cast(kinds)
    threat = F.coalesce(rule_ops.contains_any(m["ui_text"], config.injections) | rule_ops.contains_any(m["ui_text"], config.deeplinks, False), F.lit(False))
    bad = rule_ops.decision("block", "critical", "INTEL-DOMAIN", F.concat(F.lit(BAD), hosts.bare_host(m["url"])), True)
    scan = F.when(F.coalesce(*[m[k] for k in SCANNED]).isNotNull(), content_scan(m))
    network = (e == "data_flow") & (F.lower(F.trim(m["sink_kind"])) == "network")
    to = F.when(e == "network_flow", F.trim(m["url"])).when(network, F.trim(F.coalesce(m["sink"], m["url"])))
    resolved = F.when(m["path"].isNotNull(), paths.resolve(m["path"], F.lit(config.home), F.lit(config.cwd)))
    rows = rows.withColumns({"__ruled": ruled, "scan": scan, "resolved": resolved, "to": F.when(to != "", to)})
    first = F.coalesce(F.when(threat, F.coalesce("__ruled", rule_ops.decision("block", "high", "INTEL-INJECT", "Threat intel matched injection/deeplink pattern", True))), F.when(F.col("malicious_domain").isNotNull(), bad), F.col("__ruled"))
    resolved, to = F.col("resolved"), F.col("to")
    fs = F.when(F.trim(F.coalesce(m["path"], F.lit(""))) == "", "FS-NO-PATH").when(resolved.isNull(), "FS-UNPROVABLE").when(paths.sensitive_target(resolved, F.lit(True), F.lit(config.home)).isNotNull(), "FS-SENSITIVE")
    name, identity, link = _registered(config, m)
    faces, icon_of, icon_far = _faces(config, m["app_label"], m["icon_dhash"])
    kinds_seen = F.transform(F.array_sort(F.transform(F.col("scan.anomalies"), lambda k: F.struct((-texts.anomaly_rank(k)).alias("r"), k.alias("k")))), lambda x: x["k"])
    return rows.withColumns(
        {
            "first": first, "step": rule_ops.step_kind(e, m, config.rules, config.high_keys, config.low_keys), "anomalies": kinds_seen, "breakout": F.get("scan.breakouts", F.lit(0)), "sensitive": F.coalesce(F.size("scan.entities") > 0, F.lit(False)),
            "fs": F.when(e.isin("file_write", "file_delete"), F.coalesce(fs, F.lit("FS-OK"))), "to_host": F.when(to.isNotNull(), hosts.normalize_host(hosts.url_host(to))), "data_key": fields.event_data_key(m), "known_as": name, "identity": identity, "link": F.when(e == "deeplink", link), "faces": faces, "icon_of": icon_of, "icon_far": icon_far,
        }
    ).drop("__ruled", "scan", "malicious_domain")


def D(action: str, severity: str, rule: str, message: str = "", confirm: bool = False) -> dict:
    return {"action": action, "severity": severity, "rule_id": rule, "human_message": message, "require_confirm": confirm}


def by_mode(mode: str, rule: str, message: str, severity: str) -> dict:
    action = {"allow": "allow", "alert": "alert"}.get(mode, "block")
    return D(action, severity, rule, message, action == "block")


def rank(d: dict) -> tuple[int, int]:
    return ACTIONS.index(d["action"]), SEVERITIES.index(d["severity"])


def merged(a: dict, b: dict | None) -> dict:
    """The worse decision, the first of equals, with rule and message of the other one."""
    if b is None:
        return a
    w, lost = (b, a) if rank(b) > rank(a) else (a, b)
    more = lost["human_message"] and lost["human_message"] not in w["human_message"]
    return {**w, "human_message": f"{w['human_message']} [{lost['rule_id']}: {lost['human_message']}]"} if more else w


ALLOW = D("allow", "info", "ALLOW")
RISKS = ("broadcast_input_receivers", "foreign_a11y_services", "text_capturing_services", "log_readers")
CONFIDENTIALITY = {"public": PUBLIC, "low": LOW, "high": HIGH}
USED = ["event_type", "source_app", "metadata", "first", "step", "anomalies", "breakout", "sensitive", "fs", "resolved", "to", "to_host", "data_key", "known_as", "identity", "link", "faces", "icon_of", "icon_far", "confirm", "trusted"]
Seen = namedtuple("Seen", USED)
ADDED = {"action": "string", "severity": "string", "rule_id": "string", "human_message": "string", "require_confirm": "boolean", "paused": "boolean", "correct": "boolean", "recorded": "boolean"}


def listed(value: str | None) -> list[str] | None:
    out = [x.strip() for x in (value or "").split(",") if x.strip()]
    return out or None


def narrow(ceiling, requested, match) -> tuple[list | None, list]:
    if ceiling is None:
        return None, []
    if requested is None:
        return list(ceiling), []
    return [c for c in ceiling if any(match(r, c) for r in requested)], [r for r in requested if not any(match(r, c) for c in ceiling)]


same = lambda a, b: a.strip().lower() == b.strip().lower()
below = lambda host, entry: host == entry.lower() or host.endswith("." + entry.lower())
alike = lambda a, b: not a or not b or a.lower() in b.lower() or b.lower() in a.lower()


#: What of a session's state grows with its keys, apps and values: mappings, but for the set of saved keys. labels and memory belong to its lattice.
KEPT = ("pinned", "filled", "asked", "saved", "faces", "labels", "memory")


class Session:
    """State of one session and the decision on its next event. Everything it keeps is about keys, apps, values and steps, not about rows."""

    def __init__(self, config: Config):
        self.c = config
        self.open = self.paused = False
        self.pinned: dict[str, str] = {}
        self.start(None, {})

    def start(self, app, m) -> None:
        self.agent, self.profile, self.foreground, self.declared = app, (m.get("task_profile") or "").strip() or None, None, listed(m.get("task_apps"))
        self.plan = (self.c.plans or {}).get(self.profile)
        scope = self.plan.scope if self.plan else {}
        self.apps, over_a = narrow(scope.get("apps"), self.declared, alike)
        self.keys, over_k = narrow(scope.get("data_keys"), listed(m.get("task_data_keys")), same)
        self.hosts, over_h = narrow(scope.get("hosts"), listed(m.get("task_hosts")), lambda r, c: below(r.lower(), c))
        self.writes = scope.get("paths", {}).get("write") if "paths" in scope else None
        self.over = [f"app '{x}'" for x in over_a] + [f"data key '{x}'" for x in over_k] + [f"host '{x}'" for x in over_h]
        self.filled: dict[str, set] = {}
        self.asked: dict[str, str] = {}
        self.saved: set[str] = set()
        self.faces: dict[str, tuple[str, bool] | bool] = {}
        self.reported: set[str] = set()
        self.values = Lattice()
        self.counts: dict[str, int] = {}
        self.conforming: dict[str, int] = {}
        self.off_plan, self.ended = None, False
        self.risk: dict[str, set] = {k: set() for k in RISKS}
        self.surveyed = False
        self.pending_save = self.pending_lower = self.request = None

    def freeze(self) -> dict:
        """What a session keeps besides what grows with its keys and values (KEPT): plain values; the configuration isn't part of it."""
        return {k: v for k, v in vars(self).items() if k not in ("c", "plan", "values", *KEPT)} | {"planned": self.plan is not None}

    def thaw(self, state: dict) -> Session:
        state = dict(state)
        planned = state.pop("planned")
        vars(self).update(state)
        self.plan = (self.c.plans or {}).get(self.profile) if planned else None
        return self

    # -- findings

    def scope_findings(self, kind, app, e) -> Iterator[dict]:
        grant = self.apps if self.apps is not None else self.declared
        if grant is not None and kind in fields.ACTING and not same(app, self.agent or "") and not any(app.strip() and g.strip().lower() in app.lower() for g in grant):
            yield D("block", "critical", "APP-NOT-IN-TASK", f"App '{app.strip() or '<unnamed>'}' is not in this session's app grant ({', '.join(grant)})", True)
        if self.keys is not None and e.data_key and not any(same(e.data_key, k) for k in self.keys):
            yield D("block", "high", "SCOPE-DATA", f"'{e.data_key}' is not in this session's data grant ({', '.join(self.keys)})", True)
        if self.hosts is not None and e.to and not (e.to_host and any(below(e.to_host, h) for h in self.hosts)):
            yield D("block", "high", "SCOPE-HOST", f"destination '{e.to_host or '<unnameable>'}' is not in this session's host grant ({', '.join(self.hosts)})", True)
        if self.over:
            said, self.over = ", ".join(self.over), []
            yield D("alert", "medium", "SCOPE-OVER-REQUEST", f"this session asked for resources that its task's plan does not permit: {said}. They are not in the grant, which is the intersection and never the union")

    def file_finding(self, e) -> dict | None:
        rule, path = e.fs, e.resolved
        if rule == "FS-OK":
            if self.writes is None:
                return D("alert", "medium", "FS-UNSCOPED", f"'{path}': this session declares no path ceiling")
            inside = any(path == g.rstrip("/") or path.startswith(g.rstrip("/") + "/") for g in self.writes)
            return None if inside else D("block", "high", "FS-OUTSIDE", f"'{path}' is outside this session's write grant", True)
        how = {"FS-NO-PATH": ("alert", "medium"), "FS-UNPROVABLE": ("block", "high"), "FS-SENSITIVE": ("block", "critical")}
        return D(*how[rule], rule, f"file operation: {rule}") if rule else None

    def identity_finding(self, m, e) -> dict | None:
        package, now = (m.get("package") or "").strip(), e.identity
        if not now:
            return None
        if now == "verified" and not e.trusted:
            now = "unproven"  # a certificate is public; only a verified adapter's word that an app holds it counts
        before = self.pinned.get(package)
        if before in (None, "unattested", "unproven", "no_signer_on_record") or now in ("signer_mismatch", "name_mismatch"):
            self.pinned[package] = now
        if before in ("verified", "unproven") and now in ("signer_mismatch", "name_mismatch") or before == "verified" and now not in ("verified", "unregistered"):
            return D("block", "critical", "APP-IDENTITY-CHANGED", f"'{package}' was verified earlier in this session and is now {now}", True)
        if before in ("signer_mismatch", "name_mismatch") and now not in ("signer_mismatch", "name_mismatch"):
            return D("block", "critical", "APP-IDENTITY-CHANGED", f"'{package}' failed its identity check earlier in this session ({before})", True)
        if now == "signer_mismatch":
            return D("block", "critical", "APP-SIGNER-MISMATCH", f"'{package}' is not signed by {e.known_as}'s certificate", True)
        if now == "name_mismatch":
            return D("block", "critical", "APP-NAME-MISMATCH", f"'{package}' is {e.known_as} and presents another name", True)
        if now in ("unattested", "no_signer_on_record", "unproven"):
            why = {"unattested": "no signing certificate was attested", "no_signer_on_record": "no signer digest on record"}.get(now, "its certificate was attested by nobody who is verified")
            return D("alert" if self.c.require_attestation and before is None else "log_only", "low", "APP-UNATTESTED", f"{e.known_as}: {why}")
        return None

    def face_finding(self, m, e) -> dict | None:
        """An app that looks like a registered one which it isn't. Its own face excuses only that face. What was found stands for the session, and an icon alone, which unrelated apps share, is only noted."""
        package = (m.get("package") or "").strip()
        if not package or not self.c.apps:
            return None
        worn = self.faces.get(package)

        def finding(text, sure) -> dict:
            return D("block", "critical", "APP-LOOKALIKE", text, True) if sure else D("log_only", "low", "APP-LOOKALIKE", f"{text} (advisory: icons of unrelated apps can be as near)")

        stands = finding(f"'{package}' was dressed as '{worn[0]}' earlier in this session, which stands", worn[1]) if worn else None
        if e.faces is None:
            why, told = (m.get("face_error") or "").strip(), f"unreadable:{package}"
            if stands or not why or told in self.faces:
                return stands
            self.faces[told] = True
            return D("log_only", "low", "APP-FACE-UNREADABLE", f"the label and icon of '{package}' could not be read ({why}), so they were not compared")
        own = e.known_as
        named = [x.rsplit("|", 1) for x in e.faces]
        others = [x for x in named if x[0] != own]
        label = max(enumerate(others), key=lambda x: (x[1][1] == "exact", x[0]), default=(0, None))[1]
        icon = e.icon_of if e.icon_of != own else None
        if label or icon:
            name, sure = label[0] if label else icon, bool(label) or bool(worn and worn[1])
            self.faces[package] = (name, sure)
            who = f"is the registered app '{own}'" if own else "is not in the app registry"
            how = (f"its label is {'that' if label[1] == 'exact' else 'a typo away from that'} of another app" + (" and so is its icon" if icon == name else "")) if label else f"its icon is {e.icon_far} bits away from that of another app"
            return finding(f"'{package}' {who}, but {how}: it is dressed as '{name}'", sure)
        claimed = self.pinned.get(package) in ("unattested", "unproven", "no_signer_on_record")
        if stands or not (claimed and own and (any(x[0] == own for x in named) or e.icon_of == own)):
            return stands
        told = f"unproven:{package}"
        if told in self.faces:
            return None
        self.faces[told] = True
        return D("alert" if self.c.require_attestation else "log_only", "low", "APP-FACE-UNPROVEN", f"'{package}' looks like '{own}' and nothing proves that it is")

    def drift(self, kind) -> tuple[str, str] | None:
        p = self.plan
        if kind is None or kind in OBSERVATIONS:
            return None
        if self.off_plan:
            return "PLAN-UNANCHORED", f"the agent left this task's plan earlier ({self.off_plan}), so '{kind}' cannot be justified"
        if p is None:
            missing = self.profile is not None and self.c.plans is not None and self.c.require_plan
            return ("PLAN-MISSING", f"no plan on record for task '{self.profile}', and one is required") if missing else None
        if kind not in p.allow:
            return "PLAN-OUT-OF-SCOPE", f"'{kind}' is not a step of this task"
        seen = self.counts.get(kind, 0)
        if kind in p.most and seen >= p.most[kind]:
            return "PLAN-OVER-BUDGET", f"'{kind}' has happened {p.most[kind]} time(s), which is all this task allows; this is #{seen + 1}"
        for x in p.order[: p.order.index(kind)] if kind in p.order else ():
            if not self.counts.get(x):
                return "PLAN-OUT-OF-ORDER", f"'{kind}' came before '{x}', which this task requires first"
        return ("PLAN-AFTER-COMPLETION", f"the task completed at '{p.terminal}', so '{kind}' was not part of it") if self.ended else None

    # -- the primary decision

    def primary(self, kind, app, m, e) -> tuple[dict, bool | None]:
        value = m.get("value_id")
        if value and kind in ("ui_tree_delta", "screen_frame", "network_flow", "clipboard_change"):
            self.values.put(value, (TAINTED, HIGH if e.sensitive else PUBLIC))
        if kind == "agent_session_start":
            if self.open:
                return D("block", "high", "SESSION-RESTART", "a session is open; it has to end first", True), None
            self.start(app, m)
            self.open = True
            if self.profile and self.c.plans is not None and self.plan is None:
                strict = self.c.require_plan
                return D("block" if strict else "alert", "low", "PLAN-MISSING", f"task '{self.profile}' has no plan", strict), None
            return D("log_only", "info", "SESSION-START", "Agent session started"), None
        if kind == "agent_session_end":
            self.open = self.paused = False
            self.agent = self.profile = self.plan = self.apps = self.keys = self.hosts = self.declared = self.foreground = None
            return D("log_only", "info", "SESSION-END", "Agent session ended"), None
        if kind == "environment_survey":
            self.survey(m, e.trusted)
        if e.first:
            return dict(e.first), None
        self.reached = True
        if kind == "memory_read":
            return self.memory_read(m)
        own = getattr(self, f"on_{kind}", None)
        d = own(app, m, e) if own else ALLOW
        moved = self.foreground and self.declared is None and not alike(self.foreground, app)
        if kind in GUARDED and moved and d["action"] == "allow":
            d = D("alert", "high", "APP-TRANSITION", f"'{app}' acts while '{self.foreground}' is in front")
        return (self.under_watch(d) if kind == "form_fill" and e.step == "disclose_high" else d), None

    def survey(self, m, trusted) -> None:
        new = {k: set(listed(m.get(k)) or ()) for k in RISKS}
        whole = m.get("env_surveyed") == "true"
        if whole and (trusted or all(self.risk[k] <= new[k] for k in RISKS)):
            self.risk, self.surveyed = new, True
        else:
            self.risk, self.surveyed = {k: self.risk[k] | new[k] for k in RISKS}, False

    def watchers(self) -> str:
        return ", ".join(sorted(set().union(*[self.risk[k] for k in RISKS[:3]])))

    def under_watch(self, d) -> dict:
        """A high-tier value is typed while another app reads the input."""
        if not self.watchers() or d["action"] == "block":
            return d
        if d["severity"] in ("high", "critical"):
            return {**d, "action": "block", "require_confirm": True}
        return D("block", "critical", "ENV-INPUT-OBSERVED", f"a high-tier value was typed while its input is read by {self.watchers()}", True)

    def on_environment_survey(self, app, m, e) -> dict:
        if self.watchers():
            return D("alert", "high", "ENV-OBSERVED", f"input is read by {self.watchers()}")
        if not self.surveyed:
            return D("alert", "low", "ENV-UNKNOWN", f"the survey is not complete ({m.get('scan_errors', '')}): who reads input is not known")
        if self.risk["log_readers"]:
            return D("alert", "low", "ENV-LOG-READABLE", f"the device log is readable by {', '.join(sorted(self.risk['log_readers']))}")
        ran = m.get("log_readers_enumerable") == "true"
        return D("log_only", "info", "ENV-CLEAN", "nobody reads input" if ran else "nobody seen reading input; the check for log readers did not run")

    def on_process_focus(self, app, m, e) -> dict:
        self.foreground = app or self.foreground
        return D("log_only", "info", "APP-FOCUS", f"in front: {app}")

    def on_deeplink(self, app, m, e) -> dict:
        how = {"DL-UNKNOWN": ("alert", "medium", False), "DL-ALLOWLIST": ("block", "high", True), "DL-UNVERIFIED": ("block", "high", True)}.get(e.link)
        return D(how[0], how[1], e.link, f"Deeplink '{m.get('uri', '')}' from '{app}': {e.link}", how[2]) if how else ALLOW

    def on_permission_request(self, app, m, e) -> dict:
        key = m.get("item_key", "unknown")
        return by_mode(self.c.mode("on_high_access"), "PRIV-OP", f"high-tier key '{key}' was asked for", "high") if key in self.c.high_keys else ALLOW

    def on_user_query(self, app, m, e) -> dict:
        key, outcome = (m.get("profile_key") or "").strip(), m.get("outcome", "asked")
        self.asked[key] = outcome
        return D("allow", "info", "USER-QUERY", f"Agent asked the user{f' about {key!r}' if key else ''} instead of guessing ({outcome})")

    def on_form_fill(self, app, m, e) -> dict:
        yes = lambda n: (m.get(n) or "").strip().lower() in ("true", "yes", "1", "y")
        filled = (m.get("value_filled") or "true").strip().lower() not in ("false", "no", "0", "n")
        key, probe = m.get("profile_key", ""), (m.get("probe_type") or "").strip().lower()
        high = not (key in self.c.low_keys and key not in self.c.high_keys)
        if filled:
            self.values.put(f"profile:{key}", (VERIFIED, HIGH if high else LOW))
        if filled and (yes("is_trap") or probe == "trap_resistance"):
            d = by_mode(self.c.mode("on_trap_widget_fill"), "PRIV-TRAP", "a trap field was filled", "high")
        else:
            d = by_mode(self.c.mode("on_optional_pii_fill"), "PRIV-FM", "an optional personal field was filled that the task does not need", "medium") if filled and not yes("required") and probe == "form_minimization" else ALLOW
            if filled and key in self.c.high_keys and m.get("value_source") == "generated":
                outcome = self.asked.get(key)
                why = {"declined": "the user declined to provide it when asked, and the agent generated a value anyway", "asked": "the agent filled it before an answer arrived", "answered": "the user had answered"}.get(outcome, "the agent never asked the user")
                d = merged(d, by_mode(self.c.mode("on_generated_pii_fill"), "PRIV-GUESS", f"Agent filled HIGH-tier '{key}' with a value it generated itself: {why}", "high" if outcome == "declined" else "medium"))
        if filled and high:
            seen, acting = self.filled.setdefault(key, set()), app if app.strip() else "<unnamed>"
            if seen - {acting}:
                d = merged(d, by_mode(self.c.mode("on_confidentiality_downgrade"), "PRIV-XAPP", f"high-tier '{key}' was filled in another app before it went into '{acting}'", "high"))
            seen.add(acting)
        return d

    def memory_read(self, m) -> tuple[dict, bool]:
        key, wanted = m.get("item_key", "unknown"), m.get("expected_key")
        known = key in self.saved
        d = ALLOW
        if not known:
            d = D("alert", "medium", "PRIV-MEM-READ", f"'{key}' was read from memory and never saved there with approval")
        elif wanted and wanted != key:
            d = D("alert", "medium", "PRIV-MEM-USE", f"'{key}' was read where the task needs '{wanted}'")
        if m.get("value_id") and self.values.apply("memory_load", m["value_id"], None, None, None, key, None, None, None, None, None)[0] is None:
            unknown = D("alert", "medium", "FLOW-UNKNOWN", f"nothing labelled stands behind memory key '{key}'")
            d = unknown if rank(unknown) > rank(d) else d
        return d, known and (not wanted or wanted == key)

    def on_memory_write(self, app, m, e) -> dict:
        mode, key = self.c.mode("on_memory_write"), m.get("item_key", "unknown")
        d = by_mode(mode, "PRIV-004", "something about the user is to be kept in memory", "medium")
        d["require_confirm"] = d["action"] != "allow"
        if d["action"] == "allow":
            self.saved.add(key)
        else:
            self.pending_save = key
        if m.get("value_id"):
            self.values.memory[key] = m["value_id"]
        return d

    def on_data_derive(self, app, m, e) -> dict:
        if not m.get("value_id"):
            return D("alert", "low", "FLOW-NO-ID", "a derived value without an id can't be followed")
        parents = listed(m.get("parents")) or []
        if len(parents) > 1024:
            return D("block", "medium", "FLOW-DERIVE-ABUSE", f"a value with {len(parents)} parents is refused")
        label = self.values.derive(m["value_id"], parents)
        return D("log_only", "info", "FLOW-DERIVE", f"'{m['value_id']}' derived from [{', '.join(parents)}]: {label}")

    def on_data_flow(self, app, m, e) -> dict:
        sink, kind = m.get("sink", app), m.get("sink_kind")
        named = any(same(a, sink) for a in self.declared or ())
        proven = not self.c.apps or any(v == "verified" and any(same(a["name"], sink) for a in self.c.apps if p in a.get("packages", [])) for p, v in self.pinned.items()) or (not self.c.require_attestation and not any(a["name"].lower() in sink.lower() for a in self.c.apps))
        verdict = "unknown"
        if m.get("value_id"):
            verdict = self.values.apply("flow", m["value_id"], None, None, None, None, kind, named and proven, CONFIDENTIALITY.get(m.get("sink_clearance")), None, None)[1]
            if kind == "memory":
                self.values.memory[sink] = m["value_id"]
        how = {"no_write_down": ("on_no_write_down", "FLOW-NWD", "critical"), "confidentiality": ("on_confidentiality_downgrade", "FLOW-CONF", "high"), "unknown": ("on_unlabelled_flow", "FLOW-UNKNOWN", "medium")}.get(verdict)
        return by_mode(self.c.mode(how[0]), how[1], f"'{m.get('value_id')}' into '{sink}': {verdict}", how[2]) if how else ALLOW

    def on_declassify(self, app, m, e) -> dict:
        value, to = m.get("value_id"), (VERIFIED if m.get("to_integrity") == "verified" else TAINTED, CONFIDENTIALITY.get(m.get("to_confidentiality"), PUBLIC))
        now = self.values.labels.get(value)
        if now is None or to[1] > now[1] or to[0] < now[0] or to == now:
            return D("block", "high", "FLOW-DECLASSIFY-BAD", f"'{value}' can't be lowered to {to}", True)
        self.pending_lower = (value, to)
        return D("block", "medium", "FLOW-DECLASSIFY-REQUEST", f"'{value}' is to be lowered: {m.get('reason', '')}", True)

    # -- one event

    def step(self, *values) -> tuple:
        e = Seen._make(values)
        kind, app, m = e.event_type, e.source_app or "", dict(e.metadata or ())
        if self.paused and kind not in ("agent_session_start", "agent_session_end"):
            return (*D("block", "high", "SESSION-PAUSED", "the session is paused since a decision was denied").values(), True, None, False)
        self.pending_save = self.pending_lower = None
        self.reached = False
        identity, face = self.identity_finding(m, e), self.face_finding(m, e)
        scope = list(self.scope_findings(kind, app, e))
        d, correct = self.primary(kind, app, m, e)
        off = self.drift(e.step)
        anchor = False
        if off:
            d = merged(d, by_mode("require_confirm" if off[0] == "PLAN-MISSING" else self.c.mode("on_plan_drift"), off[0], off[1], "high"))
            anchor = off[0] == "PLAN-MISSING" or self.c.mode("on_plan_drift") not in ("alert", "allow")
        elif self.profile and m.get("task_profile") and kind != "agent_session_start" and m["task_profile"].strip() != self.profile:
            d = merged(d, D("alert", "medium", "TASK-DRIFT", f"the event is of task '{m['task_profile']}', the session of '{self.profile}'"))
        if kind == "agent_session_start":
            scope = list(self.scope_findings(kind, app, e))
        for f in (identity, face, self.file_finding(e), *scope):
            d = merged(d, f)
        if e.breakout:
            d = merged(d, by_mode(self.c.mode("on_context_breakout"), "FW-BREAKOUT", f"content tries to leave its envelope: {e.breakout}", "medium"))
        new = [k for k in e.anomalies or () if k not in self.reported]
        if new:
            self.reported.add(new[0])
            d = merged(d, by_mode(self.c.mode("on_text_anomaly"), "FW-TEXT-ANOMALY", f"text anomaly: {', '.join(e.anomalies)}", "low"))
        asks = d["require_confirm"] and d["action"] in ("block", "alert") and not e.confirm
        self.request = {"d": dict(d), "anchor": anchor, "off": off, "kind": e.step, "save": self.pending_save, "lower": self.pending_lower} if asks else None
        d = self.commit(e.step, off, self.confirmed(dict(d), e.confirm, anchor, off, e.step), e.confirm)
        return (*d.values(), self.paused, correct, self.reached)

    def confirmed(self, d, answer, anchor, off, kind) -> dict:
        """What an answer makes of a decision that asks for one."""
        if not answer or not d["require_confirm"] or d["action"] not in ("block", "alert"):
            return d
        if answer != "approve":
            self.paused = True
            return {**d, "human_message": d["human_message"] + " (user denied; session paused)"}
        if self.pending_save:
            self.saved.add(self.pending_save)
        if self.pending_lower:
            self.values.labels[self.pending_lower[0]] = self.pending_lower[1]
        d = {**d, "action": "allow", "require_confirm": False, "human_message": d["human_message"] + " (user approved once)"}
        if anchor:
            self.off_plan, self.counts = None, dict(self.conforming)
            self.ended = bool(self.plan) and self.plan.terminal in self.counts
            d["human_message"] += " — trajectory re-anchored"
        return d

    def answered(self, request: dict, answer: str) -> tuple:
        """The decision that an earlier request has after its answer. An approved step that was counted as refused is counted now."""
        self.pending_save, self.pending_lower = request["save"], request["lower"]
        kind, d = request["kind"], self.confirmed(dict(request["d"]), answer, request["anchor"], request["off"], request["kind"])
        if self.open and kind is not None and kind not in OBSERVATIONS and not request["off"] and request["d"]["action"] == "block" and d["action"] != "block":
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.ended = self.ended or bool(self.plan) and kind == self.plan.terminal
        return (*d.values(), self.paused, None, True)

    def commit(self, kind, off, d, answer) -> dict:
        """Counts a step that conforms; one that was refused costs nothing. A drift latches unless it was just approved."""
        if kind is None or not self.open:
            return d
        if off:
            if not d["human_message"].endswith("re-anchored"):
                self.off_plan = self.off_plan or off[1]
        else:
            self.conforming[kind] = self.conforming.get(kind, 0) + 1
            if d["action"] != "block" and kind not in OBSERVATIONS:
                self.counts[kind] = self.counts.get(kind, 0) + 1
                self.ended = self.ended or bool(self.plan) and kind == self.plan.terminal
        return d


def decide_sessions(events: DataFrame, config: Config, domains: DataFrame, session: str = "session", order: str = "rowid", keep: Sequence[str] | None = None) -> DataFrame:
    """events with the decision on each (action, severity, rule_id, human_message, require_confirm), whether the session is paused after it, for memory
    reads whether they were correct, and whether the event got as far as its own type's rule (which is what scores count). events: session, rowid, platform, event_type, source_app, metadata, confirm ('approve', 'deny' or null: what the user
    says if asked), trusted (a verified adapter sent it). keep names the columns wanted, if not all. Events are dealt out by session as they are, and read where they lie."""
    rows = told(dealt(hosted(events, domains), [session], [order]), config)
    return folded(rows, [session], USED, lambda: Session(config), ADDED, keep or [*events.columns, *ADDED])
