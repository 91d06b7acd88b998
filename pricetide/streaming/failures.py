"""Consecutive failures of stores on a stream of runs, with the pause that follows and its end.

A store's state is its number of failures in a row, the last run, and until when it is left alone.  A run that neither failed
nor succeeded (null) changes neither; runs older than the state, by time and then id, are late and dropped.  The end of
a pause is an event of its own: a timer lets it go out once the stream's time is past it, without
any further run of the store.  A success before that ends the pause without one, another failure makes it longer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pricetide.streaming.state import in_order, keep_state_on_disk

_OUT = "store_id long, at long, run_id long, failures long, until long"


class FailureRuns(StatefulProcessor):
    """Emits a row per run, and one without a run id at the end of each pause."""

    def __init__(self, threshold: int, pause_seconds: int):
        self.threshold, self.pause = threshold, pause_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "failures long, since long, run long, until long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["store_id", "at", "run_id", "failures", "until"])
        return out.assign(run_id=out["run_id"].astype("Int64"), until=out["until"].astype("Int64"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, "at", "run_id")
        n, since, run, until = self.last.get() if self.last.exists() else (0, -1, -1, None)
        out, alarm = [], until
        for stamp, own, failed in zip(rows["at"].tolist(), rows["run_id"].tolist(), rows["failed"], strict=True):
            if (stamp, own) <= (since, run):
                continue
            if until is not None and until <= stamp:
                out.append((key[0], until, None, n, None))
                until = None
            since, run, paused = stamp, own, False
            if not pd.isna(failed):
                n = n + 1 if failed else 0
                paused = bool(failed) and n >= self.threshold
                until = stamp + self.pause if paused else until if failed else None
            out.append((key[0], stamp, own, n, until if paused else None))
        if out:
            self.last.update((n, since, run, until))
            if alarm != until:
                if alarm is not None:
                    self.handle.deleteTimer(alarm // 1000)
                if until is not None:
                    self.handle.registerTimer(until // 1000)
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, since, run, until = self.last.get()
        if until is not None:
            self.last.update((n, since, run, None))
            yield self._frame([(key[0], until, None, n, None)])


def failure_states(runs: DataFrame, threshold: int = 3, pause_seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """``runs``: store_id, ts, run_id, failed.  Ends of pauses have no run_id and the pause's end as their time."""
    keep_state_on_disk(runs.sparkSession)
    stamped = runs.withWatermark("ts", delay).select("store_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "run_id", "failed")
    out = stamped.groupBy("store_id").transformWithStateInPandas(FailureRuns(threshold, pause_seconds), _OUT, "Append", "EventTime")
    return out.select("store_id", F.timestamp_micros("at").alias("ts"), "run_id", "failures", F.timestamp_micros("until").alias("backoff_until"))
