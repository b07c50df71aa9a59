"""How long streams take for a frame, as a table.

A sensor sends a frame each 100 ms or so; a stream keeps up where a trigger takes less
than that for each frame it hands on. What a trigger did is counted by Spark beside the
work itself (observe), and kept by a listener, a row a trigger.

    times = CycleTimes()
    spark.streams.addListener(times)
    observed(scans).writeStream.queryName("scans")...
    times.table(spark).filter("late")
"""

from __future__ import annotations

from collections import deque
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "frames"
SCHEMA = "query string, batch_id long, n_rows long, n_frames long, trigger_ms long, plan_ms long, work_ms long"


def observed(frames: DataFrame) -> DataFrame:
    """The same rows, counted while they pass; a row is a frame."""
    return frames.observe(NAME, F.count(F.lit(1)).alias("n"))


class CycleTimes(StreamingQueryListener):
    """Rows of the last `keep` triggers of all queries of a session."""

    def __init__(self, keep: int = 10_000):
        self._rows, self._lock = deque(maxlen=keep), Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs
        frames = p.observedMetrics.get(NAME)
        row = (p.name, p.batchId, p.numInputRows, frames["n"] if frames is not None else None, took.get("triggerExecution"), took.get("queryPlanning"), took.get("addBatch"))
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession, bound_ms: float = 100.0) -> DataFrame:
        """A row a trigger with ms_a_frame and whether that exceeds the bound; both null where
        no frame passed or none were counted."""
        with self._lock:
            rows = list(self._rows)
        t = spark.createDataFrame(rows, SCHEMA)
        t = t.withColumn("ms_a_frame", F.when(F.col("n_frames") > 0, F.col("trigger_ms") / F.col("n_frames")))
        return t.withColumn("late", F.col("ms_a_frame") > bound_ms)
