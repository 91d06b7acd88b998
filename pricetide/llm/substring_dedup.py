"""Substring deduplication: seed and extend over winnowed anchors.

A run of ``window`` words that also starts in a document of smaller id is removed.

Seed: every window holds an anchor, the k-word run with the smallest hash in it (winnowing), and
equal windows hold equal anchors at equal places.  Only anchors found in several documents go on.

Extend: each occurrence is extended both ways as far as windows over it reach.  Occurrences whose
extensions agree throughout form a class, represented by its smallest document: all windows over
the anchor are repeats in the others.  Where the extensions of an anchor differ, the
representatives of its classes compare their windows one by one, by 128-bit hashes; no pairs of documents
are formed: a passage in a third of all rows, each time in other surroundings, costs the rows of its windows.

Anchors, classes and windows of very many occurrences are few (``HOT_KEYS`` at most, as each has so large a
part of all): what is known of them is broadcast, and their rows are spread evenly in the joins.

Keep: runs of at least ``window`` words, merged into maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricetide.llm.common import free_names, materialize, slices, tidy
from pricetide.llm.words import Texts, mix, signed

WINDOW = 50
ANCHOR = 16
#: A key is hot from so many rows on, and from this part of all rows on.
HOT_ROWS, HOT_KEYS = 10_000, 50_000


def winnow(texts: Texts, prefix: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows: the rightmost smallest k-word hash in each."""
    none = np.zeros(0, np.int64)
    if texts.n < window:
        return none, none.view(np.uint64)
    at = np.arange(texts.n - k + 1)
    hashes = texts.span(prefix, at, at + k)
    bits = max(24, int(texts.n).bit_length())
    low = np.uint64((1 << bits) - 1)
    ranked = (hashes & ~low) | (low - at.astype(np.uint64))
    width = window - k + 1
    padded = np.full(-(-len(ranked) // width) * width, ~np.uint64(0))
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    has = np.zeros(texts.n + 1, np.int64)  # windows start in begin .. end - window of each text
    long = texts.counts >= window
    np.add.at(has, texts.begin[long], 1)
    np.add.at(has, texts.end[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(has))
    least = np.minimum(back[starts], ahead[starts + width - 1])
    chosen = np.unique(low - (least & low)).astype(np.int64)
    return chosen, hashes[chosen]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids may repeat: 15 bits of the text's hash tell such rows apart."""
    return df.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null").withColumn("_tag", F.pmod(F.xxhash64("_text"), F.lit(32749)).cast("int"))


_OCCURRENCES = "anchor long, context long, _id long, _tag int, at int"


def _occurrences(keyed: DataFrame, window: int, k: int) -> DataFrame:
    reach = window - k

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = Texts(part.column("_text"))
            prefix = texts.prefix()
            at, hashes = winnow(texts, prefix, window, k)
            doc = np.searchsorted(texts.end, at, side="right")
            first, last = np.maximum(texts.begin[doc], at - reach), np.minimum(texts.end[doc], at + window)
            context = texts.span(prefix, first, last) ^ mix(((at - first) << 16 | (last - at)).astype(np.uint64), 7)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(signed(context)), part.column("_id").take(take), part.column("_tag").take(take), pa.array((at - texts.begin[doc]).astype(np.int32))], names=["anchor", "context", "_id", "_tag", "at"])

    return keyed.mapInArrow(run, _OCCURRENCES)


def _windows(placed: DataFrame, window: int, k: int) -> DataFrame:
    """Hashes of all windows over the given anchors of each text."""
    reach = window - k

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = Texts(part.column("_text"))
            prefix, second = texts.prefix(), texts.prefix(5)
            anchors = part.column("anchors")
            doc = np.repeat(np.arange(part.num_rows), anchors.value_lengths().to_numpy(zero_copy_only=False))
            at = anchors.flatten().to_numpy(zero_copy_only=False) + texts.begin[doc]
            starts = (at[:, None] - np.arange(reach + 1)).ravel()
            doc = np.repeat(doc, reach + 1)
            fits = (starts >= texts.begin[doc]) & (starts + window <= texts.end[doc])
            starts, pick = np.unique(starts[fits], return_index=True)
            doc = doc[fits][pick]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(signed(texts.span(prefix, starts, starts + window))), pa.array(signed(texts.span(second, starts, starts + window))), part.column("_id").take(take), part.column("_tag").take(take), pa.array((starts - texts.begin[doc]).astype(np.int32))], names=["hash", "hash2", "_id", "_tag", "at"])

    return placed.mapInArrow(run, "hash long, hash2 long, _id long, _tag int, at int")


def _attach(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """``rows`` with the columns of ``keyed`` (one row per key; null where it has none).  Keys under the
    condition ``hot`` are broadcast, and their rows get salted keys that meet nothing in the join of the others."""
    rest = [c for c in keyed.columns if c not in keys]
    known = F.broadcast(keyed.filter(hot).select(*keys, F.struct(*rest).alias("_hot")))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id", "at"), F.lit(1 << 16)) + 1)
    salted = rows.join(known, keys, "left").withColumn("_salt", salt.cast("long"))
    other = keyed.filter(~hot).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*rest).alias("_cold"))
    joined = salted.join(other, [*keys, "_salt"], "left").withColumn("_all", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *(F.col(f"_all.{c}").alias(c) for c in rest))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Word ranges that repeat earlier documents: (_id, _tag, first, last), not yet merged."""
    keyed = _keyed(df, id_col, text_col)
    found = _occurrences(keyed, window, k)
    shared = found.groupBy("anchor").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count("*").alias("n"), (F.min("context") < F.max("context")).alias("several"))
    shared = materialize(shared.filter("lo < hi").select("anchor", "n", "several"), "shared")
    hot = F.col("n") >= max(HOT_ROWS, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    found = materialize(_attach(found, shared, ["anchor"], hot).filter("several is not null").drop("n"), "anchors")
    classes = materialize(found.groupBy("anchor", "context").agg(F.min("_id").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "classes")
    found = _attach(found, classes, ["anchor", "context"], hot).withColumn("lead", F.coalesce("lead", "_id"))
    found = materialize(found.filter("_id > lead or several").select("_id", "_tag", "at", (F.col("_id") > F.col("lead")).alias("whole")), "leads")
    whole = found.filter("whole").select("_id", "_tag", F.greatest(F.col("at") - (window - k), F.lit(0)).alias("first"), (F.col("at") + window).alias("last"))
    leads = found.filter("not whole").groupBy("_id", "_tag").agg(F.collect_set("at").alias("anchors"))
    windows = materialize(_windows(keyed.join(leads, ["_id", "_tag"]), window, k), "windows")
    least = windows.groupBy("hash", "hash2").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count("*").alias("n")).filter("least < most")
    least = materialize(least.select("hash", "hash2", "n", "least"), "least")
    hot = F.col("n") >= max(HOT_ROWS, (least.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    single = _attach(windows, least, ["hash", "hash2"], hot).filter("_id > least").select("_id", "_tag", F.col("at").alias("first"), (F.col("at") + window).alias("last"))
    return whole.unionByName(single)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR, collapse: bool = True) -> DataFrame:
    """``df`` with repeated words removed from ``text_col``, and ``n_words``, ``n_removed`` and
    ``removed`` (maximal spans of word positions) added.

    Kept words are joined by one blank, unchanged; without ``collapse`` this is only done to texts
    that lose words.  Windows are judged on the input.  A null text
    has no words and stays null; rows whose id is null or no integer neither lose words nor count as
    sources; rows of the same id never count against each other; columns named like an added one
    are replaced, others stay whatever their names; an empty table gives none.
    """
    added = T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("removed", T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType())))
    df = df.drop(*(f.name for f in added))
    own_id, own_tag, own_spans = free_names(df, "_id", "_tag", "_spans")
    spans = repeats(df, id_col, text_col, window, k).groupBy(F.col("_id").alias(own_id), F.col("_tag").alias(own_tag)).agg(F.collect_set(F.struct("first", "last")).alias(own_spans))
    tagged = df.withColumn(own_id, F.col(id_col).try_cast("long")).withColumn(own_tag, F.pmod(F.xxhash64(text_col), F.lit(32749)).cast("int"))
    joined = tagged.join(spans, [own_id, own_tag], "left").select(*df.columns, own_spans)
    out = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(out)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            kept, n_words, n_removed, removed = [], [], [], []
            for text, found in zip(part.column(text_col).cast(pa.binary()).to_pylist(), part.column(own_spans).to_pylist(), strict=True):
                words = text.split() if text else []
                merged: list[list[int]] = []
                for first, last in sorted((s["first"], min(s["last"], len(words))) for s in found or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(last, merged[-1][1])
                    else:
                        merged.append([first, last])
                rest, begin = [], 0
                for first, last in merged:
                    rest += words[begin:first]
                    begin = last
                rest += words[begin:]
                kept.append(None if text is None else (b" ".join(rest) if merged or collapse else text).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(rest))
                removed.append([{"first": a, "last": b} for a, b in merged])
            new = {text_col: kept, "n_words": n_words, "n_removed": n_removed, "removed": removed}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return joined.mapInArrow(run, out)
