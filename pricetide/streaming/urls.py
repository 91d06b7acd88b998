"""New product URLs on a stream of sitemap entries, at most so many of a store in a period.

An entry that comes again within the watermark's delay is dropped, so are URLs that are known already.  What is over the cap
waits in the store's state and goes out in the following periods, first come first served; a timer
sees to that without further entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pricetide.operators.ingest import URLS_PER_POLL, listed_urls
from pricetide.streaming.state import in_order, keep_state_on_disk

_OUT = "store_id long, url string, period long"


class Paced(StatefulProcessor):
    """Emits each URL with the number of the period whose share it takes."""

    def __init__(self, cap: int, seconds: int):
        self.cap, self.period = cap, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.share = handle.getValueState("share", "period long, taken long")
        self.waiting = handle.getListState("waiting", "url string")

    def _run(self, store: int, rows: list[tuple[str, int]], until: int | None) -> Iterator[pd.DataFrame]:
        """Let waiting URLs go period by period up to each row's own and to ``until``; a row waits if the share is used up."""
        period, taken = self.share.get() if self.share.exists() else (-1, 0)
        waiting = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        alarm, out, at = (period + 1 if waiting else None), [], 0

        def advance(to: int) -> None:
            nonlocal period, taken, at
            while period < to and at < len(waiting):
                period, taken = period + 1, min(self.cap, len(waiting) - at)
                out.extend((store, u, period) for u in waiting[at : at + taken])
                at += taken
            if period < to:
                period, taken = to, 0

        for url, own in rows:
            advance(own)
            if at == len(waiting) and taken < self.cap:
                out.append((store, url, period))
                taken += 1
            else:
                waiting.append(url)
        if until is not None:
            advance(until)
        self.share.update((period, taken))
        left = [(u,) for u in waiting[at:]]
        self.waiting.put(left) if left else self.waiting.clear()
        wanted = period + 1 if left else None
        if wanted != alarm:
            if alarm is not None and until is None:
                self.handle.deleteTimer(alarm * self.period // 1000)
            if wanted is not None:
                self.handle.registerTimer(wanted * self.period // 1000)
        yield pd.DataFrame(out, columns=["store_id", "url", "period"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, "at", "url")
        yield from self._run(key[0], list(zip(rows["url"], (rows["at"] // self.period).tolist(), strict=True)), None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key[0], [], expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.period)


def new_urls(entries: DataFrame, known: DataFrame, words: list[str], cap: int = URLS_PER_POLL, period_seconds: int = 3600, delay: str = "1 day") -> DataFrame:
    """``entries``: store_id, url, ts (a stream); ``known``: store_id, url (a table).  (store_id, url, period): each
    new URL once, at the period (number since 1970) in which it is to be fetched."""
    keep_state_on_disk(entries.sparkSession)
    fresh = entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["store_id", "url"])
    wanted = listed_urls(fresh, known, words).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return wanted.groupBy("store_id").transformWithStateInPandas(Paced(cap, period_seconds), _OUT, "Append", "EventTime")
