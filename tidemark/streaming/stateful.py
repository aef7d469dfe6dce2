"""Streaming forms of the session operators.

Each is the streaming counterpart of a batch operator and keeps bounded state for each key: throttling, bursts, and replays within a
watermark. Whole sessions are in streaming/sessions.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.sessions import WINDOW_MS

THROTTLED = "key string, timestamp_ms long, emit boolean, repeats int"


def throttle(events: DataFrame, key: str = "key", window_ms: int = WINDOW_MS) -> DataFrame:
    """Streaming throttle: (key, timestamp_ms, emit, repeats). State is the last emission and what was held back since."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0)
        rows = []
        for t in sorted(int(x) for p in parts for x in p["timestamp_ms"]):
            if last is None or t - last >= window_ms:
                rows.append((k[0], t, True, held))
                last, held = t, 0
            else:
                held += 1
                rows.append((k[0], t, False, held))
        if last is not None:
            state.update((last, held))
        yield pd.DataFrame(rows, columns=["key", "timestamp_ms", "emit", "repeats"])

    rows = events.select(F.col(key).cast("string").alias("key"), "timestamp_ms")
    return rows.groupBy("key").applyInPandasWithState(fold, THROTTLED, "last long, held int", "append", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Streaming bursts: first, last and total of runs of a key without a pause over gap."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("total")).drop("session_window")


def without_replays(events: DataFrame, keys: list[str], time: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Events but for those whose keys were seen within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended to Parquet at path; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
