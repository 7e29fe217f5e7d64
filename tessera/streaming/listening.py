"""Progress of streams and batches as callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class ProgressListener(StreamingQueryListener):
    """Tells ``report`` (query name, kind, rows) of each start, batch and end of the session's streams."""

    def __init__(self, report: Callable[[str, str, int], None]) -> None:
        self.report = report
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or ""
        self.report(event.name or "", "started", 0)

    def onQueryProgress(self, event) -> None:
        self.report(event.progress.name or "", "progress", int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(self.names.pop(str(event.id), ""), "failed" if event.exception else "succeeded", 0)


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Rows whose metrics (aggregates) are known after the first action on them, from the observation's ``get``, without another pass."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(n) for n, c in metrics.items())), seen
