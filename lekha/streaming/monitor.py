"""Observation of runs: metrics beside a plan, and a listener that keeps each stream's progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df and an observation that holds the metrics after an action; the plan is run once."""
    watch = Observation()
    return df.observe(watch, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]), watch


class Progress(StreamingQueryListener):
    """The last ``keep`` progress reports: (query name, batch, rows, rows a second)."""

    def __init__(self, keep: int = 1000):
        self.keep, self.reports = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports = [*self.reports, (p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
