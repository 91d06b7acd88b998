"""Token ids in Arrow stream files of fixed-size lists, with zero-copy random access.

A file is one Arrow IPC stream: batches of ``BATCH_ROWS`` sequences, each a fixed-size list of
``length`` ids and one of as many mask bits (false: padding after the file's last id).  All
batches but the last have the same size, so a sequence is found by arithmetic: in a memory map without
a copy, elsewhere by reading its batch alone.
Documents follow each other in id order without gaps; the index table says where each begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import fresh_path, slices, texts_of, tidy
from pricetide.llm.tokens import library_encoder

LENGTH = 2048
BATCH_ROWS = 128
END_ID = 2
#: A file takes no further text once it holds so many ids.
FILE_TOKENS = 1 << 25
#: Files open, and batches of each in memory, at once in a reading task.
OPEN_FILES, OPEN_BATCHES = 4, 4


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; Spark's name of S3 is taken too."""
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class Writer:
    """Appends ids to one file."""

    def __init__(self, uri: str, length: int, width: str):
        where, path = _at(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        kind = pa.from_numpy_dtype(np.dtype(width))
        self.length, self.dtype = length, np.dtype(width)
        self.kinds = (pa.list_(kind, length), pa.list_(pa.bool_(), length))
        self.schema = pa.schema([pa.field("ids", self.kinds[0]), pa.field("mask", self.kinds[1])])
        self.file = where.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.waiting, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        step = self.length * BATCH_ROWS
        if self.held >= step:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % step
            for k in range(0, whole, step):
                self._write(flat[k : k + step])
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.length)
        ids = np.zeros(rows * self.length, self.dtype)
        ids[: len(flat)] = flat
        mask = np.arange(len(ids)) < len(flat)
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.kinds[0]), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.kinds[1])], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.waiting))
        self.stream.close()
        self.file.close()


class Reader:
    """Random access to one file; on a local file system arrays are views of the mapped file."""

    def __init__(self, uri: str):
        where, path = _at(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.schema = pa.ipc.open_stream(self.source).schema
        self.length = self.schema.field("ids").type.list_size
        self.begin = self.source.tell()
        first = pa.ipc.read_message(self.source)
        self.step = self.source.tell() - self.begin
        rows = len(pa.ipc.read_record_batch(first, self.schema))
        # the last batch may be shorter; an end mark of 8 bytes follows it
        self.n_batches = 1 if rows < BATCH_ROWS else -(-(self.source.size() - 8 - self.begin) // self.step)
        self.batch = lru_cache(OPEN_BATCHES)(self._batch)

    def _batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.begin + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``."""
        b, r = divmod(k, BATCH_ROWS)
        batch = self.batch(b)
        return batch.column("ids")[r].values.to_numpy(), batch.column("mask")[r].values.to_numpy(zero_copy_only=False)

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file."""
        step, out = self.length * BATCH_ROWS, []
        while n > 0:
            b, at = divmod(start, step)
            part = self.batch(b).column("ids").flatten().to_numpy(zero_copy_only=True)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint32)])


def write(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, width: str = "uint16", path: str | None = None) -> DataFrame:
    """Encode texts, append ``end_id``, write files of ``FILE_TOKENS`` ids (and less than a slice of texts
    more) for ranges of ids; return the index: (id, shard, file, local_start, n_tokens), itself
    written beside the files.

    Files are named by task attempt and only those in the committed index count, so lost
    executors and repeated tasks leave no trace in it.  Null and empty texts are the end id
    alone; null ids come first; rows of one id lie side by side, ordered by text; other columns
    are not read; an empty table gives an empty index.  ``width`` must hold the largest id.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "tokens")
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    kind = to_arrow_type(id_type)
    most = np.iinfo(width).max

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer, name, shard = TaskContext.get(), library_encoder(tokenizer), None, "", -1
        end = end_id.to_bytes(4, "little")
        for part in slices(batches, text_col):
            if writer is None:
                shard = task.partitionId() << 24 if shard < 0 else shard + 1
                name = f"{path}/data/part-{shard:012d}-{task.taskAttemptId()}.arrows"
                writer = Writer(name, length, width)
            found = [ids + end for ids in encoder.encode(texts_of(part, text_col))]
            n, ids = len(found), np.frombuffer(b"".join(found), "<u4")
            if int(ids.max()) > most:
                raise ValueError(f"an id is too large for {width}")
            sizes = np.fromiter(map(len, found), np.int64, n) // 4
            starts = writer.total + np.cumsum(sizes) - sizes
            writer.add(ids.astype(width))
            yield pa.RecordBatch.from_arrays([part.column(id_col).cast(kind), pa.array(np.full(n, shard)), pa.array([name] * n, pa.string()), pa.array(starts), pa.array(sizes)], names=out.names)
            if writer.total >= FILE_TOKENS:
                writer = writer.close()
        if writer is not None:
            writer.close()

    by = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.col(text_col)]
    sorted_df = df.select(id_col, text_col).repartitionByRange(*by[:2]).sortWithinPartitions(*by)
    sorted_df.mapInArrow(run, out).write.parquet(f"{path}/index")
    return spark.read.schema(out).parquet(f"{path}/index")


def read(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document from the files: (id, start, n_tokens, ids as little-endian unsigned 32-bit).
    ``start`` counts the ids of all documents before it, over all files in order."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    id_type = index.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    kind = to_arrow_type(id_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = lru_cache(OPEN_FILES)(Reader)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                part = whole.slice(k, 1024)
                ids = [reader(f).read(s, n).astype("<u4").tobytes() for f, s, n in zip(*(part.column(c).to_pylist() for c in ("file", "local_start", "n_tokens")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(kind), part.column("start"), part.column("n_tokens"), pa.array(ids, pa.binary())], names=out.names)

    placed = index.join(bases, "shard").select(id_col, "file", "local_start", "n_tokens", (F.col("base") + F.col("local_start")).alias("start")).sortWithinPartitions("file", "local_start")
    return placed.mapInArrow(run, out)
