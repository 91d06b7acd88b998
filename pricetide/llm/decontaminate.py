"""Passages of benchmark items inside documents: a prefix-filtered containment join.

A window is a run of ``window`` item words (a shorter item is one window of its own size).  It consists
of overlapping shingles, and a document can contain the window only if it holds every one of them.

1. How often each shingle of the benchmark occurs in all documents is counted; a bit table of bounded
   size, made from the benchmark, keeps nearly all other shingles from being sent.
2. Shingles are ordered by rarity.  As all of a window's shingles are required, the prefix that any
   containing document must share is the rarest one; a window with a shingle that occurs nowhere is out.
3. Documents send only their occurrences of such prefix shingles and meet the windows on these.  The
   document must be long enough, and the window's place, fixed by the shingle's offset in it, must lie
   within the document.
4. What is left is verified over the window's own width, word by word (64-bit hashes of each).

A shingle of very many occurrences is cut into blocks, each of which meets a copy of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import materialize, slices, tidy
from pricetide.llm.words import Texts, mix, signed

WINDOW, SHINGLE = 10, 5
#: The bit table takes about 16 bits a shingle, and at most 2^27 (16 MB) for benchmarks of any size.
LEAST_BITS, MOST_BITS = 16, 27
#: Occurrences of a shingle under one key, and shingles that are cut into blocks, at most.
BLOCK, HOT_KEYS = 1000, 50_000
#: Digits, letters in lower case and all that is not ASCII are kept; the rest separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _texts(column: pa.Array) -> Texts:
    return Texts(pa.array([t and t.translate(_LETTERS) for t in column.cast(pa.binary()).to_pylist()], pa.binary()))


def _shingles(texts: Texts, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``size`` words that lie within one text."""
    ends = np.repeat(texts.end, texts.counts)
    at = np.flatnonzero(np.arange(texts.n) + size <= ends)
    return at, texts.span(prefix, at, at + size)


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, width, words, shingles) of every distinct window; shingles in the order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = _texts(part.column("text"))
            prefix = texts.prefix()
            widths = np.minimum(texts.counts, window)
            text = np.repeat(np.arange(len(widths)), np.where(texts.counts > 0, texts.counts - widths + 1, 0))
            start = np.arange(len(text)) - np.searchsorted(text, text) + texts.begin[text]
            rows = {"words": [], "shingles": []}
            for t, a in zip(text.tolist(), start.tolist(), strict=True):
                size = min(shingle, int(widths[t]))
                at = np.arange(a, a + widths[t] - size + 1)
                rows["words"].append(texts.hashes[a : a + widths[t]].tobytes())
                rows["shingles"].append(signed(texts.span(prefix, at, at + size)))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(text)), pa.array(widths[text].astype(np.int32)), pa.array(rows["words"], pa.binary()), pa.array(rows["shingles"], pa.list_(pa.int64()))], names=["item", "width", "words", "shingles"])

    return items.mapInArrow(run, "item string, width int, words binary, shingles array<long>").dropDuplicates(["item", "width", "words"])


class _Bits:
    """A table of 2^bits bits in which every key has two set; others rarely have."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def slots(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
        return mix(keys, 31 + k) >> np.uint64(64 - bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys that may be among those of the table."""
        at = np.arange(len(keys))
        for k in range(2):
            slots = self.slots(keys[at], self.bits, k)
            at = at[self.table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1 == 1]
        return at


def _bit_table(keys: DataFrame) -> _Bits:
    """Built in parts of 8 KB by the executors; the driver gets MOST_BITS bits at most, whatever comes."""
    bits = int(np.clip(np.ceil(np.log2(16 * (keys.count() + 1))), LEAST_BITS, MOST_BITS))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            slots = np.concatenate([_Bits.slots(found, bits, k) for k in range(2)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 16), pa.array((slots & 0xFFFF).astype(np.int32))], names=["part", "slot"])

    def fill(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, np.uint8)
        own[table.column("slot").to_numpy()] = 1
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    slots = keys.mapInArrow(parts, "part long, slot int").distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, raw in slots.groupBy("part").applyInArrow(fill, "part long, bits binary").collect():
        out[part << 13 : (part + 1) << 13] = np.frombuffer(raw, np.uint8)
    return _Bits(out, bits)


def _counted(docs: DataFrame, wanted: _Bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): occurrences in all documents, of the benchmark's shingles and a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = _texts(part.column("text"))
            prefix = texts.prefix()
            for size in sizes:
                _, hashes = _shingles(texts, prefix, size)
                found, n = np.unique(hashes[shared.value.has(hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _prefixes(windows: DataFrame, counted: DataFrame) -> DataFrame:
    """(item, width, words, shingle, place, n): each window's rarest shingle; ``n`` is how often it occurs."""
    singles = windows.select("item", "width", "words", F.posexplode("shingles").alias("place", "shingle"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")
    rarest = singles.join(counted, "shingle", "left").groupBy("item", "width", "words").agg(F.min(rarity).alias("x"))
    return rarest.filter("x.n > 0").select("item", "width", "words", "x.*")


_SEED = T.StructType().add("shingle", T.LongType()).add("at", T.IntegerType()).add("before", T.IntegerType()).add("context", T.BinaryType())


def _seeded(docs: DataFrame, wanted: _Bits, sizes: list[int], window: int) -> DataFrame:
    """(id, tag, n_words, seeds): occurrences of prefix shingles with the words around them, as far as any
    window over them can reach."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    seed = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = _texts(part.column("text"))
            prefix = texts.prefix()
            found = [_shingles(texts, prefix, size) for size in sizes]
            kept = [shared.value.has(hashes) for _, hashes in found]
            none = np.zeros(0, np.int64)
            at = np.concatenate([none, *(a[k] for (a, _), k in zip(found, kept, strict=True))])
            keys = np.concatenate([none.view(np.uint64), *(h[k] for (_, h), k in zip(found, kept, strict=True))])
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            doc = np.searchsorted(texts.end, at, side="right")
            first, last = np.maximum(texts.begin[doc], at - window + 1), np.minimum(texts.end[doc], at + window)
            contexts = [texts.hashes[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            fields = [pa.array(signed(keys)), pa.array((at - texts.begin[doc]).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(contexts, pa.binary())]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows))))[: part.num_rows + 1]
            seeds = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(seed)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(texts.counts), seeds], names=["id", "tag", "n_words", "seeds"])

    out = T.StructType().add("id", docs.schema["id"].dataType).add("tag", T.LongType()).add("n_words", T.LongType()).add("seeds", T.ArrayType(_SEED))
    return docs.mapInArrow(run, out)


def _met(seeds: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(id, tag, first, width, item): verified occurrences of windows."""
    kinds = prefixes.select("shingle", "n").distinct()
    bound = max(BLOCK, (kinds.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(kinds.filter(F.col("n") >= bound).select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = seeds.join(hot, "shingle", "left").withColumn("block", F.pmod(F.xxhash64("id", "tag", "at"), blocks).cast("int")).drop("blocks")
    copies = prefixes.join(hot, "shingle", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks", "n")
    after = F.length("context") / 8 - F.col("before")
    long_enough = F.col("n_words") >= F.col("width")
    inside = (F.col("place") <= F.col("before")) & (F.col("width") - F.col("place") <= after)
    same = F.col("context").substr((8 * (F.col("before") - F.col("place")) + 1).cast("int"), 8 * F.col("width")) == F.col("words")
    met = dealt.join(copies, ["shingle", "block"]).filter(long_enough & inside).filter(same)
    return met.select("id", "tag", (F.col("at") - F.col("place")).alias("first"), "width", "item")


def find(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_words, n_hit, hits, items, contaminated) for every row of ``df``.

    Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII.  ``hits`` are the
    maximal runs (first, last) of words inside any occurrence of a window, ``n_hit`` their words, and
    ``items`` the ids, as sorted strings, of items with an occurring window.  Null and empty texts have no
    words and no windows; an item of fewer words than ``window`` is one window; an item without an id
    marks words, but is not listed; items of one id count together.  Rows with equal ids, or without one, are judged
    each by its own text; other columns are not read; without documents there are no rows, without items no hits.
    """
    kind = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    shingle = min(shingle, window)
    windows = materialize(_windows(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")), window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("width", F.lit(shingle))).distinct().collect())  # at most ``shingle`` of them
    wanted = windows.select(F.explode("shingles").alias("shingle")).distinct()
    prefixes = materialize(_prefixes(windows, _counted(docs, _bit_table(wanted), sizes)), "prefixes")
    table = _bit_table(prefixes.select("shingle").distinct())
    seeded = materialize(_seeded(docs, table, sizes, window), "seeds")
    seeds = seeded.select("id", "tag", "n_words", F.explode("seeds").alias("s")).select("id", "tag", "n_words", "s.*")
    hits = _met(seeds, prefixes).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "width")).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    keys = hits.select(F.col("id").alias("hit_id"), F.col("tag").alias("hit_tag"), "places", "items")
    known = seeded.select("id", "tag", "n_words").join(keys, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag")), "left")
    span = T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType())
    out = T.StructType().add(id_col, kind).add("n_words", T.LongType()).add("n_hit", T.LongType()).add("hits", T.ArrayType(span)).add("items", T.ArrayType(T.StringType())).add("contaminated", T.BooleanType())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, n_hit = [], []
            for places in batch.column("places").to_pylist():
                merged: list[dict[str, int]] = []
                for first, last in sorted((p["first"], p["first"] + p["width"]) for p in places or ()):
                    if merged and first <= merged[-1]["last"]:
                        merged[-1]["last"] = max(last, merged[-1]["last"])
                    else:
                        merged.append({"first": first, "last": last})
                runs.append(merged)
                n_hit.append(sum(r["last"] - r["first"] for r in merged))
            found = pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), found, batch.column("items"), pa.array([n > 0 for n in n_hit])], names=out.names)

    return known.select("id", "n_words", "places", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(merge, out)
