"""The log of runs: when each began, how far it got and how it ended, and what its ingests counted.

Rows are only ever appended; a run's present state is its last row.  The counts of an ingest come from the write itself
(an ``Observation``), so nothing is read twice for them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.ingest import valid_rows

JOB_TYPES = ("daily_sweep", "hot_refresh", "sitemap_poll", "single_store")
LOG = "run_id string, job_type string, store_label string, status string, at timestamp, stores_total int, stores_done int, rows long, dropped long, cut long"


def _append(spark: SparkSession, log: str, **values) -> None:
    names = [c.split()[0] for c in LOG.split(", ")]
    spark.createDataFrame([tuple(values.get(n) for n in names)], LOG).coalesce(1).write.mode("append").parquet(log)


def begin(spark: SparkSession, log: str, job_type: str, store_label: str | None = None, stores_total: int | None = None, at: dt.datetime | None = None) -> str:
    """A new run's id; ``stores_total`` is null for a single store."""
    if job_type not in JOB_TYPES:
        raise ValueError(f"no job type: {job_type!r}")
    run_id = uuid.uuid4().hex
    _append(spark, log, run_id=run_id, job_type=job_type, store_label=store_label, status="running", at=at or dt.datetime.now(), stores_total=stores_total)
    return run_id


def store_done(spark: SparkSession, log: str, run_id: str, store_label: str, rows: DataFrame, write: Callable[[DataFrame], None], at: dt.datetime | None = None) -> dict[str, int]:
    """Check a store's rows and ``write`` the good ones; how many there were, were dropped and had texts cut goes to the log."""
    seen = Observation(f"{run_id}-{store_label}")
    write(valid_rows(rows.observe(all_rows := Observation(f"{run_id}-{store_label}-rows"), F.count(F.lit(1)).alias("rows")), seen))
    counts = {"rows": all_rows.get["rows"], "dropped": seen.get["dropped"], "cut": seen.get["cut"]}
    _append(spark, log, run_id=run_id, store_label=store_label, at=at or dt.datetime.now(), stores_done=1, **counts)
    return counts


def finish(spark: SparkSession, log: str, run_id: str, status: str, at: dt.datetime | None = None) -> None:
    if status not in ("completed", "failed"):
        raise ValueError(f"no end of a run: {status!r}")
    _append(spark, log, run_id=run_id, status=status, at=at or dt.datetime.now())


def states(log: DataFrame) -> DataFrame:
    """A row per run: its kind, last status, begin and end, stores done and in total, rows, dropped and cut.

    A store that is logged twice in a run (it was tried again) counts once, with its last numbers; of the same
    time the greatest."""
    stores = log.filter("status is null").groupBy("run_id", "store_label").agg(F.max(F.struct("at", "rows", "dropped", "cut")).alias("c"))
    sums = stores.groupBy("run_id").agg(F.count("*").alias("stores_done"), *(F.sum(f"c.{c}").alias(c) for c in ("rows", "dropped", "cut")))
    marks = log.filter("status is not null")
    order = F.struct("at", F.col("status") != "running", "status")
    first = [F.min_by(c, order).alias(c) for c in ("job_type", "store_label", "stores_total")]
    runs = marks.groupBy("run_id").agg(*first, F.max_by("status", order).alias("status"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"))
    return runs.join(sums, "run_id", "left").fillna(0, ["stores_done", "rows", "dropped", "cut"])


def last_of_stores(log: DataFrame) -> DataFrame:
    """The last counts of each store, whatever the run: store_label, run_id, at, rows, dropped, cut."""
    last = F.max_by(F.struct("run_id", "at", "rows", "dropped", "cut"), F.struct("at", "run_id"))
    return log.filter("status is null").groupBy("store_label").agg(last.alias("l")).select("store_label", "l.*")
