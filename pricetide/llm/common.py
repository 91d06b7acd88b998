"""Helpers shared by the operators: shared storage, bounded Arrow slices, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about this many bytes, whatever Spark's batch size is.
SLICE_BYTES = 2 << 20
#: Rows and bytes of a batch on its way to Python while a table is written.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: For ``materialize``: the shuffle files behind a table go as soon as it is written, not when the driver's garbage is collected.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master, whose
    executors are the driver, may do without and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pricetide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/pricetide-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: lineage ends here, and a lost
    executor costs its running tasks only.  ``conf`` holds while it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    conf = BATCH_CONF | (conf or {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its case, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(1, batch.column(column).nbytes)))
        for k in range(0, n, step):
            yield batch.slice(k, step)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give memory back at the end of a partition: workers live on, and what they keep adds up over the
    stages of a pipeline."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return call


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
