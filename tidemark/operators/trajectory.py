"""Plan drift over ordered steps, as window expressions.

Steps count only until the first drift of a session (after that everything is unanchored), so the first drift follows from running
counts and the rest from a running flag: no row-by-row state is needed. With re-approvals the counts depend on which steps conformed, so those
sessions are folded in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scale import in_order

OBSERVATIONS = ("observe", "recall_memory")


@dataclass(frozen=True)
class Plan:
    """A task plan: what kinds of steps it allows, how often, in which order, what ends it, and its ceilings (apps, data_keys, hosts, paths; absent: none)."""

    allow: tuple[str, ...]
    most: dict[str, int] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    terminal: str | None = None
    goal: str = ""
    scope: dict = field(default_factory=dict)


def judge(steps: DataFrame, plan: Plan, session: str = "session", order: str = "rowid", kind: str = "kind", executed: str | None = None, observations: tuple[str, ...] = OBSERVATIONS) -> DataFrame:
    """steps with drift: 'out_of_plan', 'over_budget', 'out_of_order', 'after_terminal', 'unanchored' or null, the first that applies.

    Only steps that ran (executed, all if not given) count towards budgets, order and end. Observations never drift.
    """
    k, by = F.col(kind), Window.partitionBy(session).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ran = F.col(executed) if executed else F.lit(True)
    seen = lambda x: F.coalesce(F.count_if((k == x) & ran & k.isin(list(plan.allow))).over(before), F.lit(0))
    over = F.lit(False)
    for x, most in plan.most.items():
        over = over | ((k == x) & (seen(x) >= most))
    unordered = F.lit(False)
    for i, x in enumerate(plan.order):
        for earlier in plan.order[:i]:
            unordered = unordered | ((k == x) & (seen(earlier) == 0))
    ended = (seen(plan.terminal) > 0) if plan.terminal else F.lit(False)
    own = F.when(k.isin(list(observations)), None).when(~k.isin(list(plan.allow)), "out_of_plan").when(over, "over_budget").when(unordered, "out_of_order").when(ended, "after_terminal")
    rows = steps.withColumn("__own", own)
    fallen = F.coalesce(F.max(F.col("__own").isNotNull()).over(before), F.lit(False))
    return rows.withColumn("drift", F.when(k.isin(list(observations)), F.lit(None).cast("string")).when(fallen, "unanchored").otherwise(F.col("__own"))).drop("__own")


class _Reanchored:
    """Counts, end and latch of one session under a plan; kinds are few, so the state is small."""

    def __init__(self, plan: Plan, observations: tuple[str, ...]):
        self.plan, self.observations = plan, observations
        self.counts, self.conforming = {}, {}
        self.ended = self.latched = False

    def judge(self, kind):
        p = self.plan
        if kind in self.observations:
            return None
        if self.latched:
            return "unanchored"
        if kind not in p.allow:
            return "out_of_plan"
        if kind in p.most and self.counts.get(kind, 0) >= p.most[kind]:
            return "over_budget"
        if kind in p.order and any(not self.counts.get(x) for x in p.order[: p.order.index(kind)]):
            return "out_of_order"
        return "after_terminal" if self.ended else None

    def step(self, kind, executed, approved):
        drift = self.judge(kind)
        if drift:
            self.latched = True
        else:
            self.conforming[kind] = self.conforming.get(kind, 0) + 1
            if executed and kind not in self.observations:
                self.counts[kind] = self.counts.get(kind, 0) + 1
                self.ended = self.ended or kind == self.plan.terminal
        if approved:
            self.latched, self.counts = False, dict(self.conforming)
            self.ended = self.plan.terminal in self.counts
        return (drift,)


def reanchored(steps: DataFrame, plan: Plan, approved: str, session: str = "session", order: str = "rowid", kind: str = "kind", executed: str | None = None, observations: tuple[str, ...] = OBSERVATIONS) -> DataFrame:
    """judge() with re-approvals: a row whose column approved is true is judged as it stands and then clears the latch for the rows behind it.

    Counts and the end of the task are built anew from all steps of the session that conformed, so an approval refunds no budget. The fold's state is a
    few counts for each session.
    """
    rows = steps.withColumn("__ran", F.col(executed) if executed else F.lit(True)).withColumn("__approved", F.coalesce(approved, F.lit(False)))
    out = in_order(rows, [session], [order], [kind, "__ran", "__approved"], lambda: _Reanchored(plan, observations), {"drift": "string"})
    return out.drop("__ran", "__approved")


def drift_score(judged: DataFrame, session: str = "session", kind: str = "kind", observations: tuple[str, ...] = OBSERVATIONS) -> DataFrame:
    """Share of judged steps that drifted; null for sessions without any."""
    acts = ~F.col(kind).isin(list(observations))
    return judged.groupBy(session).agg(F.count_if(acts).alias("judged"), F.count_if(acts & F.col("drift").isNotNull()).alias("drifted")).withColumn("drift_score", F.try_divide("drifted", "judged"))


def transitions(events: DataFrame, session: str = "session", order: str = "rowid", app: str = "source_app", focus: Column | None = None) -> DataFrame:
    """events with transition: the acting app differs from the one focused last before it."""
    focused = F.col("event_type") == "process_focus" if focus is None else focus
    last = F.last(F.when(focused, F.col(app)), ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("focused_app", last).withColumn("transition", F.coalesce((~focused) & (F.col(app) != F.col("focused_app")), F.lit(False)))
