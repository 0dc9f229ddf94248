"""Reader events as a stream: each once, and the state of every session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIONS = ("view", "click", "error")
REENTRY_MS, OPENED_MOST, TIRED = 600_000, 20, 0.65
STATE = "last_ms long, opened int"
OUT = "user_id long, event_id long, reentry boolean, fatigue double, tired boolean"


def unique_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Allowed actions with an id, each id once within the delay that late events may have."""
    return events.where(F.col("event_type").isin(*ACTIONS) & F.col("event_id").isNotNull()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def step(last_ms: int | None, opened: int, ts_ms: int, action: str) -> tuple[int, int, bool, float]:
    """One event: the new state, whether the reader came back, and how tired of support they are."""
    opened = min(OPENED_MOST, opened + (action == "click"))
    return ts_ms if last_ms is None else max(last_ms, ts_ms), opened, last_ms is not None and ts_ms - last_ms >= REENTRY_MS, min(1.0, opened / 8)


def _session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, opened = state.get if state.exists else (None, 0)
    out = []
    for rows in batches:
        for ts, event, action in rows.sort_values(["ts", "event_id"])[["ts", "event_id", "event_type"]].itertuples(index=False):
            last, opened, back, fatigue = step(last, opened, int(ts.timestamp() * 1000), action)
            out.append((key[0], event, back, fatigue, fatigue >= TIRED))
    if last is not None:
        state.update((last, opened))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "reentry", "fatigue", "tired"])


def session_signals(events: DataFrame) -> DataFrame:
    """Per event of a session: back after ten minutes, and fatigue by opened units; the state is two numbers a session."""
    return events.groupBy("user_id").applyInPandasWithState(_session, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def visits(events: DataFrame, delay: str = "1 hour", gap: str = "10 minutes") -> DataFrame:
    """Events per visit in event time. Two events exactly a gap apart fall into one visit here, unlike in session_signals."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")
