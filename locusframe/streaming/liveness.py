"""Worker liveness and rates over a stream of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def window_rates(snapshots: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Per worker and window: snapshots, mean value and the last time seen.

    State is bounded: windows older than the watermark are closed and forgotten.
    """
    return (
        snapshots.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "worker_id")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("ts").alias("last_seen"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "worker_id", "n", "mean_value", "last_seen")
    )


def suspected(rates: DataFrame, seconds: int = 30) -> DataFrame:
    """Workers that went silent more than so many seconds before their window ended."""
    return rates.withColumn("suspected_dead", F.col("last_seen") < F.col("end") - F.expr(f"interval {seconds} seconds"))


class Watch(StatefulProcessor):
    """One worker: when it was last seen, whether it has been reported, and a timer that its next sign of life moves."""

    def __init__(self, seconds: int):
        self.silence = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp, silent boolean")

    def _told(self, key, status: str, at) -> pd.DataFrame:
        return pd.DataFrame({"worker_id": [key[0]], "status": [status], "last_seen": [at]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max(x["ts"].max() for x in rows)
        before, silent = self.seen.get() if self.seen.exists() else (None, None)
        if silent is None or silent:
            yield self._told(key, "alive", last)
        if before is not None:
            last = max(pd.Timestamp(before), last)
        self.seen.update((last.to_pydatetime(), False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, _ = self.seen.get()
        self.seen.update((last, True))
        yield self._told(key, "dead", last)

    def close(self) -> None:
        pass


def watched(snapshots: DataFrame, seconds: int = 30) -> DataFrame:
    """C7f: ``worker_id``, ``status`` and ``last_seen``: a row when a worker shows up or comes back, and one when it has been silent.

    Silence is told by a timer of the worker's own, so many seconds after its last
    snapshot came in, whether or not anything comes in after.  State is a time and a flag for each worker; the session
    needs the RocksDB state store (:data:`STORE`).
    """
    return snapshots.select("worker_id", "ts").groupBy("worker_id").transformWithStateInPandas(
        Watch(seconds), "worker_id string, status string, last_seen timestamp", "append", "processingTime"
    )


#: The setting under which :func:`watched` runs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
