"""Data provenance: labels of values folded in event order, flows to sinks, transitive sources, and budgets over delegation trees.

A label is (integrity: tainted 0 < verified 1, confidentiality: public 0 < low 1 < high 2); joining takes the lower integrity and the
higher confidentiality. Derived values take their parents' labels at the time of the event, so labels can't be closed over afterwards:
each session is folded in order, and sessions spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scale import in_order, table

TAINTED, VERIFIED = 0, 1
PUBLIC, LOW, HIGH = 0, 1, 2
MAX_PARENTS = 1024
#: How track() names a derive of more.
TOO_MANY = "derive of too many"


def join_labels(i1: Column, c1: Column, i2: Column, c2: Column) -> tuple[Column, Column]:
    return F.least(i1, i2), F.greatest(c1, c2)


def sink_clearance(kind: Column, declared: Column, requested: Column) -> Column:
    """Clipboard and network are cleared for public data only, others for high data if declared, else for low; a request can only lower that."""
    ceiling = F.when(kind.isin("clipboard", "network"), PUBLIC).when(declared, HIGH).otherwise(LOW)
    return F.least(ceiling, F.coalesce(requested, ceiling))


def required_integrity(kind: Column) -> Column:
    return F.when(kind.isin("critical_action", "shell_arg"), VERIFIED).otherwise(TAINTED)


def check_flow(integrity: Column, confidentiality: Column, required: Column, clearance: Column) -> Column:
    """'unknown', 'no_write_down', 'confidentiality' or 'allow', the first that applies."""
    return F.when(integrity.isNull(), "unknown").when(integrity < required, "no_write_down").when(confidentiality > clearance, "confidentiality").otherwise("allow")


class Lattice:
    """Labels of one session's values and memory keys."""

    def __init__(self) -> None:
        self.labels: dict[str, tuple[int, int]] = {}
        self.memory: dict[str, str] = {}

    def put(self, value: str, label: tuple[int, int]) -> tuple[int, int]:
        old = self.labels.get(value, label)
        self.labels[value] = (min(old[0], label[0]), max(old[1], label[1]))
        return self.labels[value]

    def derive(self, value: str, parents: Iterable[str]) -> tuple[int, int]:
        known = [self.labels.get(p) for p in parents]
        label = (min([VERIFIED, *[k[0] for k in known if k]]), max([PUBLIC, *[k[1] for k in known if k]]))
        if not known or None in known:
            label = (TAINTED, HIGH)
        return self.put(value, label)

    def declassify(self, value: str, to: tuple[int, int], approved: bool, by: str) -> str:
        now = self.labels.get(value)
        if now is None:
            return "unknown_value"
        if not approved:
            return "not_approved"
        if not by.strip():
            return "no_approver"
        if to[1] > now[1] or to[0] < now[0] or to == now:
            return "not_a_downgrade"
        self.labels[value] = to
        return "ok"

    def step(self, *values):
        label, verdict = self.apply(*values)
        return (*(label or (None, None)), verdict)

    def apply(self, op, value_id, integrity, confidentiality, parents, item_key, sink_kind, declared, clearance, approved, approved_by):
        if op == "introduce":
            return self.put(value_id, (integrity, confidentiality)), None
        if op == TOO_MANY:
            return self.put(value_id, (TAINTED, HIGH)), "too_many_parents"
        if op == "derive":
            parents = parents or []
            return (self.derive(value_id, parents), None) if len(parents) <= MAX_PARENTS else (self.put(value_id, (TAINTED, HIGH)), "too_many_parents")
        if op == "memory_save":
            self.memory[item_key] = value_id
            return self.labels.get(value_id), None
        if op == "memory_load":
            label = self.labels.get(self.memory.get(item_key, ""))
            return (self.put(value_id, label), None) if label else (None, "unknown")
        if op == "declassify":
            verdict = self.declassify(value_id, (integrity, confidentiality), bool(approved), approved_by or "")
            return self.labels.get(value_id), verdict
        label = self.labels.get(value_id)
        if label is None:
            return None, "unknown"
        ceiling = PUBLIC if sink_kind in ("clipboard", "network") else HIGH if declared else LOW
        ceiling = ceiling if clearance is None else min(ceiling, clearance)
        needed = VERIFIED if sink_kind in ("critical_action", "shell_arg") else TAINTED
        return label, "no_write_down" if label[0] < needed else "confidentiality" if label[1] > ceiling else "allow"


def track(events: DataFrame) -> DataFrame:
    """A row for each row of events with the label of its value after it, and the verdict of flows and declassifications.

    events: session, rowid, op (introduce, derive, flow, memory_save, memory_load, declassify), value_id, integrity, confidentiality,
    parents, item_key, sink_kind, declared, clearance, approved, approved_by.
    """

    used = ["__op", "value_id", "integrity", "confidentiality", "parents", "item_key", "sink_kind", "declared", "clearance", "approved", "approved_by"]
    # What is refused for its number of parents, or names one twice, isn't carried to its session at that length.
    derive, n = F.col("op") == "derive", F.coalesce(F.array_size("parents"), F.lit(0))
    events = events.withColumn("__op", F.when(derive & (n > MAX_PARENTS), TOO_MANY).otherwise(F.col("op"))).withColumn("parents", F.when(derive & (n <= MAX_PARENTS), F.array_distinct("parents")))
    out = in_order(events.select("session", "rowid", "op", *used), ["session"], ["rowid"], used, Lattice, {"__integrity": "int", "__confidentiality": "int", "verdict": "string"})
    return out.select("session", "rowid", "op", "value_id", F.col("__integrity").alias("integrity"), F.col("__confidentiality").alias("confidentiality"), "verdict")


def untrusted(events: DataFrame, verified_high: Column) -> DataFrame:
    """Introduce rows for values seen on screens, networks and clipboards: tainted, and high where the text holds a verified entity."""
    seen = F.col("event_type").isin("ui_tree_delta", "screen_frame", "network_flow", "clipboard_change")
    rows = events.where(seen & F.col("metadata")["value_id"].isNotNull())
    return rows.select("session", "rowid", F.lit("introduce").alias("op"), F.col("metadata")["value_id"].alias("value_id"), F.lit(TAINTED).alias("integrity"), F.when(verified_high, HIGH).otherwise(PUBLIC).alias("confidentiality"))


def climbed(nodes: DataFrame, low: str, most: int = 64) -> DataFrame:
    """nodes (node, parent, ...) with the column low reduced to its least value over each node and all its ancestors; nulls don't count.

    Pointer doubling: each round a node takes the least value of the node its pointer leads to, and that node's pointer. A round is one join of as many rows as there
    are nodes with a pointer left, so a chain of n nodes needs log2(n) rounds; no ancestor list is ever made. A parent without a row of its own ends the climb.
    Nodes are unique. More than `most` rounds are only needed where pointers go in circles, which raises.
    """
    rows = table(nodes.select("node", F.col("parent").alias("up"), F.col(low).alias("low")), "climb")
    for _ in range(most):
        open_ = rows.where("up is not null")
        if open_.isEmpty():
            return nodes.drop(low).join(rows.select("node", F.col("low").alias(low)), "node")
        # A pointer that many nodes share is joined with one row; Spark splits such a key where it is large.
        above = rows.select(F.col("node").alias("up"), F.col("low").alias("more"), F.col("up").alias("next"), F.lit(True).alias("there"))
        step = open_.join(above, "up", "left").select("node", F.col("next").alias("up"), F.least("low", "more").alias("low"))
        rows = table(rows.where("up is null").unionByName(step), "climb")
    raise ValueError("the parents of some nodes go in a circle")


def lineage(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, root, depth) of a forest's edges (node, parent): the highest ancestor of each node and how far away it is, by pointer doubling. Circles raise."""
    edges = edges.where("parent is not null").select("node", "parent").distinct()
    rows = table(edges.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")), "climb")
    for _ in range(most):
        if rows.where("not done").isEmpty():
            return rows.select("node", F.col("up").alias("root"), "depth")
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = rows.where("not done").join(above, "up", "left")
        step = step.select("node", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNull().alias("done"))
        rows = table(rows.where("done").unionByName(step), "climb")
    raise ValueError("the parents of some nodes go in a circle")


def remaining(nodes: DataFrame) -> DataFrame:
    """What each node of a delegation tree (node, parent, limit, used) may still use: the least of limit - used over itself and its ancestors."""
    return climbed(nodes.select("node", "parent", (F.col("limit") - F.col("used")).alias("remaining")), "remaining").select("node", "remaining")


def revoked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of the subtrees below roots (node), the roots included, also such as have no row of their own: those with a root among their ancestors or itself."""
    marked = nodes.select("node", "parent").join(roots.select("node", F.lit(0).alias("hit")).distinct(), "node", "left")
    orphans = marked.join(roots.select(F.col("node").alias("parent"), F.lit(0).alias("above")).distinct(), "parent", "left")
    below = climbed(orphans.select("node", "parent", F.least("hit", "above").alias("hit")), "hit").where("hit = 0").select("node")
    return below.unionByName(roots.select("node")).distinct()


def admit_webhooks(events: DataFrame, skew_ms: int = 300_000) -> DataFrame:
    """events (license_id, event_id, created_ms, received_ms, version, rowid) with admitted: first of its id, within the time skew, and of a version above all before."""
    by = Window.partitionBy("license_id").orderBy("rowid")
    fresh = F.abs(F.col("received_ms") - F.col("created_ms")) <= skew_ms
    first = F.row_number().over(Window.partitionBy("license_id", "event_id").orderBy("rowid")) == 1
    rows = events.withColumn("__ok", fresh & first)
    seen = F.max(F.when(F.col("__ok"), F.col("version"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("admitted", F.col("__ok") & (seen.isNull() | (F.col("version") > seen))).drop("__ok")
