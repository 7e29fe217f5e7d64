"""Progress events in windows of event time, and the run state machine, as batch or stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.state import ALLOWED


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by window and status; with ``late`` a watermark closes windows that much behind the newest event."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, slide), "status").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a run in sessions, which end after a pause of ``gap``."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "run_id").agg(F.count(F.lit(1)).alias("n"))


def run_states(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """For a stream with a watermark on ``ts``: the state of each run after its legal steps, and how many steps were illegal so far.

    Steps are taken in the order of ts and event_id within a batch; a step older than the last one taken is illegal. A run that
    sends nothing for ``idle`` of event time is dropped from the state, so the state does not grow with all runs ever seen.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, illegal, last = state.get if state.exists else (None, 0, -1)
        rows = pd.concat(parts)
        for at, to in rows.sort_values(["ts", "event_id"])[["ts", "status"]].itertuples(index=False):
            moment = at.value // 1000
            if moment >= last and to in ALLOWED.get(status, ()):
                status, last = to, moment
            else:
                illegal += 1
        state.update((status, illegal, last))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "illegal": [illegal]})

    kind = events.schema["run_id"].dataType.simpleString()
    return events.groupBy("run_id").applyInPandasWithState(
        fold, f"run_id {kind}, status string, illegal long", "status string, illegal long, last long", "update", GroupStateTimeout.EventTimeTimeout
    )
