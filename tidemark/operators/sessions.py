"""Session operators over ordered events: throttling, replays, once-per-session findings, form fills, confirmation queues."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scale import in_order

#: Metadata that a fingerprint leaves out, and windows.
VOLATILE = ("frame_digest", "low_opacity_ratio", "capture_width", "capture_height", "overlay_evidence", "overlay_count", "repeat_count")
WINDOW_MS, NONCES, ADAPTER_EVENTS = 30_000, 8192, 4096


def fingerprint(event_type: Column, app: Column, metadata: Column) -> Column:
    """A hash of type, app and the metadata that isn't volatile, keys in order, values trimmed."""
    kept = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(VOLATILE)))
    return F.xxhash64(event_type, app, F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"], F.trim(e["value"])))))


class _Throttle:
    def __init__(self, window_ms: int):
        self.window_ms, self.last, self.held = window_ms, None, 0

    def step(self, t):
        if self.last is None or t - self.last >= self.window_ms:
            out, self.last, self.held = (True, self.held), t, 0
        else:
            self.held += 1
            out = (False, self.held)
        return out


def throttle(events: DataFrame, keys: list[str], order: str = "timestamp_ms", window_ms: int = WINDOW_MS) -> DataFrame:
    """events with emit and repeats: the first of a key is emitted, then the first at least window_ms behind the last emitted one, with
    how many were held back between. The anchor moves with each emission, so this is a fold over each key in order; its state is one time and one number."""
    by = [order, *[c for c in events.columns if c == "rowid" and c != order]]
    return in_order(events, keys, by, [order], lambda: _Throttle(window_ms), {"emit": "boolean", "repeats": "int"})


def suppressed_total(throttled: DataFrame) -> DataFrame:
    return throttled.agg(F.count_if(~F.col("emit")).alias("suppressed_total"))


def bursts(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "30 seconds") -> DataFrame:
    """Runs of a key with no pause over gap: first, last, total."""
    return events.groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("total")).drop("session_window")


class _Nonces:
    def __init__(self, window: int):
        self.window, self.seen = window, OrderedDict()

    def step(self, n):
        if n in self.seen:
            return (True,)
        self.seen[n] = None
        if len(self.seen) > self.window:
            self.seen.popitem(last=False)
        return (False,)


def replays(events: DataFrame, owner: str, nonce: str, order: str = "rowid", window: int = NONCES) -> DataFrame:
    """events with replay: the nonce is among the last `window` that its owner got accepted. Which are accepted depends on those before, so
    each owner's nonces are folded in order, with a window of state."""
    return in_order(events, [owner], [order], [nonce], lambda: _Nonces(window), {"replay": "boolean"})


def once_per_session(findings: DataFrame, session: str, kind: str, order: str = "rowid") -> DataFrame:
    """The first finding of each kind in a session."""
    first = F.row_number().over(Window.partitionBy(session, kind).orderBy(order))
    return findings.withColumn("__n", first).where("__n = 1").drop("__n")


def cross_app(fills: DataFrame, session: str = "session", order: str = "rowid", key: str = "profile_key", app: str = "source_app", high: Column | None = None) -> DataFrame:
    """fills with crossed: a high-tier key filled here was filled in another app before, in the same session."""
    high = F.col("tier") == "high" if high is None else high
    acting = F.when(F.trim(F.coalesce(app, F.lit(""))) == "", "<unnamed>").otherwise(F.col(app))
    used = F.collect_set(F.when(F.col("value_filled") & high, acting)).over(Window.partitionBy(session, key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return fills.withColumn("crossed", F.col("value_filled") & high & (F.size(F.array_remove(used, acting)) > 0))


def form_decision(is_trap: Column, probe: Column, required: Column, filled: Column, generated_high: Column, answer: Column) -> Column:
    """Rule of one form fill: traps first, then values made up for high-tier keys where they weigh more, then optional personal fields."""
    trap = (is_trap | (F.coalesce(probe, F.lit("")) == "trap_resistance")) & filled
    optional = filled & ~required & (F.coalesce(probe, F.lit("")) == "form_minimization")
    return F.when(trap, "PRIV-TRAP").when(generated_high & (answer == "declined"), "PRIV-GUESS").when(optional, "PRIV-FM").when(generated_high, "PRIV-GUESS")


def memory_reads(events: DataFrame, session: str = "session", order: str = "rowid") -> DataFrame:
    """Reads (op = read, item_key, expected_key) judged by the saves (op = save, approved) before them: decision and correct."""
    before = Window.partitionBy(session, "item_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.max((F.col("op") == "save") & F.col("approved")).over(before), F.lit(False))
    rows = events.withColumn("saved", saved).where("op = 'read'")
    wrong = F.col("expected_key").isNotNull() & (F.col("expected_key") != F.col("item_key"))
    return rows.withColumn("rule_id", F.when(~F.col("saved"), "PRIV-MEM-READ").when(wrong, "PRIV-MEM-USE").otherwise("ALLOW")).withColumn("correct", F.col("saved") & ~wrong)


class _Union:
    def __init__(self, n: int):
        self.seen = [set() for _ in range(n)]

    def step(self, *lists):
        for seen, more in zip(self.seen, lists, strict=True):
            seen.update(x for x in more or () if x is not None)
        return tuple(sorted(x) for x in self.seen)


def merged_risks(surveys: DataFrame, session: str = "session", order: str = "rowid", lists: tuple[str, ...] = ("broadcast_input_receivers", "foreign_a11y_services")) -> DataFrame:
    """surveys with each risk list joined with all before it in the session: sorted distinct values. State is what was seen so far."""
    out = in_order(surveys, [session], [order], lists, lambda: _Union(len(lists)), {f"__{c}": "array<string>" for c in lists})
    return out.withColumns({c: F.col(f"__{c}") for c in lists}).drop(*[f"__{c}" for c in lists])


def protection_state(i: Column, ttl_ms: int = 10_000, grace_ms: int = 5_000) -> Column:
    """Struct (state, reasons) of a protection's inputs: session_active, pending_confirm, paused, permission_missing, capability_missing, observers_available,
    observers_running, observer_error, last_heartbeat_ms, started_ms, now_ms, audit_enabled, audit_error.

    'stopped', 'confirmation_pending', 'paused' and 'permission_required' come first, in this order; then anything that doesn't work makes it 'degraded', with all reasons; an
    observer that has just started is 'starting', and the rest 'active'.
    """
    made = lambda state, *reasons: F.struct(F.lit(state).alias("state"), F.array(*map(F.lit, reasons)).cast("array<string>").alias("reasons"))
    beat = i["last_heartbeat_ms"]
    fresh = F.coalesce(i["now_ms"] - i["started_ms"] <= grace_ms, F.lit(False)) & (i["observers_running"] > 0)
    broken = F.array_compact(
        F.array(
            F.when(i["capability_missing"], F.lit("required_capability_unavailable")), F.when(i["observers_running"] == 0, F.lit("observer_not_running")), F.when(i["observer_error"].isNotNull(), F.lit("observer_error")),
            F.when(i["now_ms"] - beat > ttl_ms, F.lit("heartbeat_stale")), F.when(beat.isNull() & ~fresh, F.lit("heartbeat_never")), F.when(~i["audit_enabled"], F.lit("audit_disabled")).when(i["audit_error"].isNotNull(), F.lit("audit_unwritable")),
        )
    )
    missing = F.array_compact(F.array(F.lit("required_observation_permission"), F.when(i["capability_missing"], F.lit("required_capability_unavailable"))))
    return (
        F.when(~i["session_active"], made("stopped", "no_session")).when(i["pending_confirm"], made("confirmation_pending", "confirm_pending")).when(i["paused"], made("paused", "engine_paused"))
        .when(i["permission_missing"], F.struct(F.lit("permission_required").alias("state"), missing.alias("reasons"))).when((i["observers_available"] == 0) & ~i["capability_missing"], made("permission_required", "no_observer_available"))
        .when(F.size(broken) > 0, F.struct(F.lit("degraded").alias("state"), broken.alias("reasons"))).when(beat.isNull(), made("starting")).otherwise(made("active"))
    )


class _Queue:
    """Live requests of one owner, oldest first, and which requests a step ended, as 'id|outcome|reply' texts."""

    def __init__(self, ttl_ms: int, capacity: int):
        self.ttl_ms, self.capacity, self.live = ttl_ms, capacity, OrderedDict()

    def step(self, at, side, request, approve):
        if side == 2:  # behind the last event nothing answers any more
            ended = [f"{r}|expired|" for r in self.live]
            self.live.clear()
            return (ended,)
        ended = [f"{r}|expired|" for r, since in self.live.items() if since > 0 and at - since > self.ttl_ms]
        for x in ended:
            del self.live[x.split("|")[0]]
        if side == 0:
            if len(self.live) >= self.capacity:
                ended.append(f"{self.live.popitem(last=False)[0]}|evicted|")
            self.live[request] = at
        elif request in self.live:
            del self.live[request]
            ended.append(f"{request}|resolved|{'true' if approve else 'false'}")
        else:
            ended.append(f"{request}|stale|{'true' if approve else 'false'}")
        return (ended,)


def confirm_queue(requests: DataFrame, replies: DataFrame, ttl_ms: int = 60_000, capacity: int = 64, owner: str | None = None) -> DataFrame:
    """Outcomes (request_id, enqueued_ms, outcome, approve, and owner if named) of requests (request_id, enqueued_ms) and of replies (request_id, replied_ms, approve).

    Each owner's queue is folded in order of time, a request before a reply of the same time, with at most `capacity` live requests as state.
    A request is 'resolved' by the first reply while it is live, 'expired' once more than ttl_ms went by (a request of time 0 never does before the end), and
    'evicted' as the oldest live one when a new one finds the queue full; requests that were answered are out of the queue and push nobody out. What
    is live at the end is 'expired'. A reply to anything that isn't live is 'stale', with a row of its own.
    """
    own = F.lit("") if owner is None else F.col(owner).cast("string")
    kind = requests.schema["request_id"].dataType.simpleString()
    asked = requests.select(own.alias("__o"), F.col("enqueued_ms").alias("__t"), F.lit(0).alias("__side"), F.col("request_id").cast("string").alias("__id"), F.lit(None).cast("boolean").alias("approve"))
    told = replies.select(own.alias("__o"), F.col("replied_ms").alias("__t"), F.lit(1).alias("__side"), F.col("request_id").cast("string").alias("__id"), "approve")
    ends = asked.select("__o").distinct().select("__o", F.lit(2**63 - 1).alias("__t"), F.lit(2).alias("__side"), F.lit(None).cast("string").alias("__id"), F.lit(None).cast("boolean").alias("approve"))
    rows = in_order(asked.unionByName(told).unionByName(ends), ["__o"], ["__t", "__side", "__id"], ["__t", "__side", "__id", "approve"], lambda: _Queue(ttl_ms, capacity), {"ended": "array<string>"})
    part = lambda i: F.get(F.split("e", "[|]"), F.lit(i))
    done = rows.select("__o", F.explode("ended").alias("e")).select("__o", part(0).cast(kind).alias("request_id"), part(1).alias("outcome"), F.when(part(2) != "", part(2) == "true").alias("approve"))
    since = requests.select(own.alias("__o"), "request_id", "enqueued_ms")
    out = done.join(since, ["__o", "request_id"], "left").withColumn("enqueued_ms", F.when(F.col("outcome") != "stale", F.col("enqueued_ms")))
    return out.select(*([] if owner is None else [F.col("__o").alias(owner)]), "request_id", "enqueued_ms", "outcome", "approve")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("r"))
    return best.select("r.*")


def current_memory(entries: DataFrame, now_ms: int, key: str = "item_key", version: str = "version") -> DataFrame:
    """Latest versions that are active and unexpired; an older version never stands in for a revoked one."""
    return latest(entries, key, version).where((F.col("state") == "active") & (F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)))


def search_memory(entries: DataFrame, terms: list[str], now_ms: int, most: int = 4) -> DataFrame:
    """Current entries whose content holds all terms, ignoring case, with the lines around the first term."""
    low = F.lower("content")
    held = F.lit(True)
    for t in terms:
        held = held & low.contains(t.lower())
    lines = F.split("content", "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains(terms[0].lower())), True).cast("int")
    return current_memory(entries, now_ms).where(held).withColumn("excerpt", F.array_join(F.slice(lines, F.greatest(at - 1, F.lit(1)), 3), "\n")).orderBy("item_key").limit(most)
