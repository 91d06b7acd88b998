"""Restock detection on a stream of stock observations.

The state of a listing is its last status, time and event.  Rows of a micro-batch are taken in time order;
a row older than the state is late and is dropped (that is this library's policy).  Each restock
goes out once.  A listing that is silent for longer than ``forget_days`` is forgotten: its next row is a
first sighting, and a timer drops the state meanwhile, so state does not grow with listings that are gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pricetide.streaming.state import in_order, keep_state_on_disk

OUT = "listing_id long, ts timestamp, event_id long, stock_status string"
_DAY = 86_400_000_000


class Restocks(StatefulProcessor):
    def __init__(self, forget_days: int):
        self.silence = forget_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, since long, event long")

    def _remember(self, state: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update(state)
        self.handle.registerTimer((state[1] + self.silence) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, "at", "event_id")
        last, since, event = self.last.get() if self.last.exists() else (None, 0, -1)
        rows = rows[(rows["at"] > since) | ((rows["at"] == since) & (rows["event_id"] > event))]
        if len(rows):
            before, then = rows["stock_status"].shift(1), rows["at"].shift(1)
            before.iloc[0], then.iloc[0] = last, since
            known = rows["at"] - then <= self.silence
            end = rows.iloc[-1]
            self._remember((end["stock_status"], int(end["at"]), int(end["event_id"])))
            yield rows[known & (before == "agotado") & (rows["stock_status"] == "disponible")][["listing_id", "ts", "event_id", "stock_status"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


def restocks(signals: DataFrame, forget_days: int = 365, delay: str = "1 hour") -> DataFrame:
    """``signals``: listing_id, ts, event_id, stock_status; rows more than ``delay`` behind the newest are dropped."""
    keep_state_on_disk(signals.sparkSession)
    stamped = signals.withWatermark("ts", delay).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return stamped.groupBy("listing_id").transformWithStateInPandas(Restocks(forget_days), OUT, "Append", "EventTime")


def notify_once(restocked: DataFrame, path: str, checkpoint: str):
    """Start an available-now query that appends restocks to a Parquet log, exactly once."""
    return restocked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
