"""The session cascade over a stream of events and a second one of replies, by transformWithState.

What grows with a session's keys, apps and values is a map in the state store, of which a micro-batch reads and writes only the entries that it
touches; the rest is one small value. Requests that ask the user wait in that value, MOST_OPEN at most. Event-time timers end requests that
nobody answers and sessions in which nothing happens any more, and with a session goes its state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, MutableMapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.cascade import ADDED, KEPT, USED, Config, Session, prepared

#: The state store that keeps maps and timers, open requests of a session, and default times to answer one and to end a session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_OPEN, ANSWER_MS, IDLE_MS = 64, 60_000, 86_400_000
#: Domains beyond which a list is no literal of a plan any more.
MOST_DOMAINS = 10_000
OUT = "session string, rowid long, outcome string, " + ", ".join(f"{n} {t}" for n, t in ADDED.items())
GONE = object()


class Kept(MutableMapping):
    """A mapping in a map state; entries are read when they are asked for and written back by flush() if they have changed."""

    def __init__(self, state):
        self.state, self.now, self.was = state, {}, {}

    def _read(self, key):
        if key not in self.now:
            found = self.state.getValue((key,))
            self.was[key] = None if found is None else bytes(found[0])
            self.now[key] = GONE if found is None else pickle.loads(self.was[key])
        return self.now[key]

    def __getitem__(self, key):
        value = self._read(key)
        if value is GONE:
            raise KeyError(key)
        return value

    def __setitem__(self, key, value):
        self._read(key)
        self.now[key] = value

    def __delitem__(self, key):
        self[key]
        self.now[key] = GONE

    def __iter__(self):
        for (key,) in list(self.state.keys()):
            self._read(key)
        return iter([k for k, v in self.now.items() if v is not GONE])

    def __len__(self):
        return sum(1 for _ in self)

    def add(self, key):
        self[key] = True

    def replaced(self, plain) -> None:
        """Everything goes, and the entries of a plain mapping or set come in."""
        self.state.clear()
        items = plain.items() if isinstance(plain, dict) else ((k, True) for k in plain)
        self.now, self.was = dict(items), {}

    def flush(self) -> None:
        for key, value in self.now.items():
            raw = None if value is GONE else pickle.dumps(value)
            if raw != self.was.get(key):
                self.state.removeKey((key,)) if raw is None else self.state.updateValue((key,), (raw,))
                self.was[key] = raw


def _plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x.asDict() if hasattr(x, "asDict") else x
    return None if isinstance(x, float) and x != x or x is pd.NaT else x


class Sessions(StatefulProcessor):
    def __init__(self, config: Config, answer_ms: int, idle_ms: int):
        self.config, self.answer_ms, self.idle_ms = config, answer_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.small = handle.getValueState("small", "raw binary")
        self.maps = {n: handle.getMapState(n, "k string", "v binary") for n in KEPT}

    def _open(self) -> None:
        self.kept = {n: Kept(m) for n, m in self.maps.items()}
        self.machine, self.waiting, self.last, self.timers = Session(self.config), {}, None, []
        if self.small.exists():
            state, self.waiting, self.last, self.timers = pickle.loads(bytes(self.small.get()[0]))
            self.machine.thaw(state)
        self._attach(False)

    def _attach(self, adopt: bool) -> None:
        """Puts the kept mappings in the machine's place for them. adopt: what the machine has put there itself, as at a session's start, replaces them."""
        for n, kept in self.kept.items():
            owner = self.machine.values if n in ("labels", "memory") else self.machine
            if getattr(owner, n) is not kept:
                if adopt:
                    kept.replaced(getattr(owner, n))
                setattr(owner, n, kept)

    def _close(self) -> None:
        for kept in self.kept.values():
            kept.flush()
        want = sorted({since + self.answer_ms + 1 for since, _ in self.waiting.values()} | ({self.last + self.idle_ms + 1} if self.last is not None else set()))
        for t in set(self.timers) - set(want):
            self.handle.deleteTimer(t)
        for t in set(want) - set(self.timers):
            self.handle.registerTimer(t)
        self.timers, self.machine.request = want, None
        self.small.update((pickle.dumps((self.machine.freeze(), self.waiting, self.last, self.timers)),))

    def _clear(self) -> None:
        self.small.clear()
        for m in self.maps.values():
            m.clear()

    def _expired(self, session: str, now: int) -> list:
        """Rows of requests that nobody answered in time; the session starts anew if nothing happened in it for too long."""
        out = []
        late = [i for i, (since, _) in self.waiting.items() if now - since > self.answer_ms]
        for i in late:
            out.append(self._row(session, i, "expired", self.waiting.pop(i)[1]["d"]))
        if self.last is not None and now - self.last > self.idle_ms:
            out.append((session, None, "ended", *[None] * len(ADDED)))
            self.machine, self.waiting, self.last = Session(self.config), {}, None
            self._attach(True)
        return out

    def _row(self, session, rowid, outcome, d) -> tuple:
        return (session, rowid, outcome, *d.values(), self.machine.paused, None, True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "side", "rowid"]).itertuples(index=False):
            out += self._expired(key[0], r.at_ms)
            if r.side == 1:
                asked = self.waiting.pop(r.rowid, None)
                out.append((key[0], r.rowid, "resolved", *self.machine.answered(asked[1], "approve" if r.approve else "deny")) if asked else (key[0], r.rowid, "stale", *[None] * len(ADDED)))
            else:
                if r.event_type in ("agent_session_start", "agent_session_end"):
                    out += [self._row(key[0], i, "expired", q["d"]) for i, (_, q) in self.waiting.items()]
                    self.waiting.clear()
                values = self.machine.step(*[_plain(getattr(r, c)) for c in USED])
                self._attach(True)
                asked = self.machine.request
                if asked:
                    if len(self.waiting) >= MOST_OPEN:
                        i = next(iter(self.waiting))
                        out.append(self._row(key[0], i, "evicted", self.waiting.pop(i)[1]["d"]))
                    self.waiting[r.rowid] = (r.at_ms, asked)
                out.append((key[0], r.rowid, "asked" if asked else "decided", *values))
            if self.small.exists() or r.side == 0 or self.last is not None:
                self.last = r.at_ms if self.last is None else max(self.last, r.at_ms)
        if self.last is None:
            self._clear()
        else:
            self._close()
        yield pd.DataFrame(out, columns=["session", "rowid", "outcome", *ADDED])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.timers = [t for t in self.timers if t != at]
        out = self._expired(key[0], at)
        if self.last is None:
            for t in self.timers:
                self.handle.deleteTimer(t)
            self._clear()
        else:
            self._close()
        yield pd.DataFrame(out, columns=["session", "rowid", "outcome", *ADDED])

    def close(self) -> None:
        pass


def streaming(events: DataFrame, replies: DataFrame, config: Config, domains: Sequence[str] = (), late: str = "1 minute", answer_ms: int = ANSWER_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Decisions on a stream of events (session, rowid, ts, platform, event_type, source_app, metadata, confirm, trusted), with a stream of replies (session, rowid of the event, ts, approve).

    Rows (session, rowid, outcome, and what decide_sessions adds). An event is 'decided', or 'asked' if the user has to say something: then its decision stands until a reply, which
    gives the row 'resolved' with the decision as the answer leaves it. A request without answer for answer_ms is 'expired', as it is when its session ends, and 'evicted' as the oldest of
    MOST_OPEN; a reply to anything else is 'stale'. A session without events for idle_ms is 'ended' (rowid null), and its state is gone. Within a micro-batch a session's rows go by time, events first, then by
    rowid. Where every answer comes before the session's next event, the decisions are those of decide_sessions with the answers in confirm, whatever the micro-batches.
    """
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{len(domains)} domains: join a list of more than {MOST_DOMAINS} before the stream")
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = prepared(events, config, domains)
    asked = rows.select(F.col("session").cast("string").alias("session"), F.col("rowid").cast("long").alias("rowid"), "ts", F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("approve"), *USED)
    kinds = {f.name: f.dataType for f in asked.schema}
    told = replies.select(F.col("session").cast("string").alias("session"), F.col("rowid").cast("long").alias("rowid"), "ts", F.lit(1).alias("side"), F.coalesce("approve", F.lit(False)).alias("approve"), *[F.lit(None).cast(kinds[c]).alias(c) for c in USED])
    both = asked.unionByName(told).withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return both.groupBy("session").transformWithStateInPandas(Sessions(config, answer_ms, idle_ms), OUT, "Append", "EventTime")
