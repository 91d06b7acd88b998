"""Packing token sequences into windows by minimum bin slack.

A window starts with the longest remaining piece; a bitset subset-sum over the multiset of
remaining lengths then finds the fill closest to capacity, and the counts of each length are
read back from the snapshots.  Partitions are packed on their own: no shuffle, and memory is
bounded by the pool, not by the partition.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import slices, texts_of, tidy
from pricetide.llm.tokens import library_encoder

CAPACITY = 2048
END_ID = 1
#: Tokens of remaining pieces that a task holds before it packs half of them.
POOL_TOKENS = 4_000_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is closest to ``room`` from below.

    Bit s of ``reach`` says that sum s can be made from the lengths seen so far.
    """
    reach, mask, seen = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        seen.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for length, before in reversed(seen):
        k = 0
        while not before >> left & 1:
            left, k = left - length, k + 1
        if k:
            out[length] = k
    return out


class Packer:
    """Pieces of one task.  ``add`` takes documents, ``pack`` yields (item, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence, self.tokens = capacity, first_sequence, 0
        self.pool: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = defaultdict(int)

    def _put(self, item, start: int, length: int) -> None:
        self.pool[length].append((item, start))
        self.counts[length] += 1
        self.tokens += length

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.tokens -= length
        return self.pool[length].pop()

    def add(self, item, total: int) -> Iterator[tuple]:
        """Full windows of a long document go out at once; the rest waits."""
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield item, start, self.capacity, self.sequence, 0
            self.sequence += 1
        if total > whole:
            self._put(item, whole, total - whole)

    def pack(self, down_to: int) -> Iterator[tuple]:
        """Fill windows until at most ``down_to`` tokens wait.  A window without exact fill takes the
        beginning of another piece; the last tokens of a task go to windows of powers of two."""
        while self.tokens > down_to:
            if self.tokens < self.capacity:
                yield from self._last()
                return
            longest = max(self.counts)
            rest = dict(self.counts)
            rest[longest] -= 1
            fill = best_fill(rest, self.capacity - longest)
            fill[longest] = fill.get(longest, 0) + 1
            slack = self.capacity - sum(k * n for k, n in fill.items())
            times = 1 if slack else min(self.counts[k] // n for k, n in fill.items())
            for _ in range(times):
                offset = 0
                for length, n in fill.items():
                    for _ in range(n):
                        item, start = self._take(length)
                        yield item, start, length, self.sequence, offset
                        offset += length
                if slack:
                    length = min(x for x in self.counts if x > slack)
                    item, start = self._take(length)
                    yield item, start, slack, self.sequence, offset
                    self._put(item, start + slack, length - slack)
                self.sequence += 1

    def _last(self) -> Iterator[tuple]:
        size, offset = 0, 0
        for length in sorted(self.counts, reverse=True):
            for item, start in self.pool[length]:
                done = 0
                while done < length:
                    if offset == size:
                        self.sequence += bool(size)
                        size, offset = 1 << (self.tokens.bit_length() - 1), 0
                    n = min(length - done, size - offset)
                    yield item, start + done, n, self.sequence, offset
                    done, offset, self.tokens = done + n, offset + n, self.tokens - n
        self.sequence += 1
        self.pool.clear()
        self.counts.clear()


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Encode ``text_col``, append ``end_id``, and pack into sequences of at most ``capacity`` tokens.

    Returns a row per piece: the id, ``start`` (its document's ids before it), ``length``,
    ``doc_tokens``, ``sequence_id`` (partition and number in it), ``offset`` and ``ids``
    (little-endian unsigned 32-bit).  Null and empty texts are the end id alone; repeated rows
    and null ids are packed like any other; other columns are not read; an empty table gives no
    rows.  A sequence is full or its size is a power of two, so nothing is padded.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow_id = to_arrow_type(id_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(tokenizer), end_id.to_bytes(4, "little")
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(7)]
            size = 0
            for (doc, ids, first, total), start, length, sequence, offset in pieces:
                for c, v in zip(cols, (doc, start, length, total, sequence, offset, ids[4 * (start - first) : 4 * (start - first + length)]), strict=True):
                    c.append(v)
                size += length
                if size >= 1 << 20:
                    yield batch(cols)
                    cols, size = [[] for _ in range(7)], 0
            if cols[0]:
                yield batch(cols)

        def batch(cols: list[list]) -> pa.RecordBatch:
            kinds = [arrow_id, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=out.names)

        def added(part: pa.RecordBatch):
            for doc, ids in zip(part.column(id_col).to_pylist(), encoder.encode(texts_of(part, text_col)), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for (item, start, *more) in packer.add((doc, whole, total), total):
                    yield (item[0], ids, 0, total), start, *more
                if total > whole:  # the waiting rest keeps its own ids only
                    packer.pool[total - whole][-1] = ((doc, ids[4 * whole :], whole, total), whole)

        for part in slices(batches, text_col):
            yield from rows(added(part))
            if packer.tokens > pool_tokens:
                yield from rows(packer.pack(pool_tokens // 2))
        yield from rows(packer.pack(0))

    return df.select(id_col, text_col).mapInArrow(run, out)
