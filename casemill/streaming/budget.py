"""Budget counters and a guard over a live call log."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_usage(stream: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls per window and run; records later than ``late`` are dropped (append mode)."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "run_id").agg(F.count("*").alias("n_calls")).select(F.col("w.start").alias("start"), "run_id", "n_calls")


def running_usage(stream: DataFrame, limit: int) -> DataFrame:
    """Running calls per run and strategy with a flag over the limit (update or complete mode)."""
    n = stream.groupBy("run_id", "strategy").agg(F.count("*").alias("n_calls"))
    return n.withColumn("over_limit", F.col("n_calls") > limit)


class _Guard(StatefulProcessor):
    """Counts a cell's calls, tells the first one over the limit, and forgets cells that have been quiet for a while."""

    def __init__(self, limit: int, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, until = self.seen.get() if self.seen.exists() else (0, 0)
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values(["ts", "call_index"])
        if n <= self.limit < n + len(batch):
            refused = batch.iloc[self.limit - n]
            yield pd.DataFrame({"run_id": [key[0]], "strategy": [key[1]], "first_refused": [int(refused["call_index"])], "ts": [refused["ts"]]})
        if until:
            self.handle.deleteTimer(until)
        until = max(until, int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        self.handle.registerTimer(until)
        self.seen.update((n + len(batch), until))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def guard(calls: DataFrame, limit: int, *, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """A stream of calls(run_id, strategy, call_index, ts) -> run_id, strategy, first_refused, ts: for each cell the first call that its
    limit refuses, once, as soon as it comes (append mode).

    Calls count in the order in which they arrive, within a trigger by time and index. Calls later than ``late`` behind the newest are dropped
    and not counted. A cell without a call for ``idle_ms`` of event time is forgotten; its count would start anew. State is kept by the
    RocksDB provider, which the session has to name (spark.sql.streaming.stateStore.providerClass).
    """
    timed = calls.select("run_id", "strategy", F.col("call_index").cast("long").alias("call_index"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("run_id", "strategy").transformWithStateInPandas(_Guard(limit, idle_ms), "run_id string, strategy string, first_refused long, ts timestamp", "Append", "EventTime")
