"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. Documents with the same shingle set collapse into one representative, the smallest id.
2. Each set gets ``bands * rows`` universal hash minima; representatives that agree on a band
   share a bucket.  Each bucket links its members to its smallest one, not to each other.
3. Of its bucket heads, each member checks the one with the most equal minima on the full sets,
   and components follow from the confirmed links.
4. Members of buckets that still hold several components are gone through exactly.  With shingles in
   order of rarity, two sets can reach the threshold only if they meet in the prefix of each that
   exceeds what may differ, and only if what follows the first meeting is long enough.  Documents of
   different components meet on such rare shingles, in bounded blocks; these pairs too are
   confirmed on full sets, and components are built again from all links.

Nothing is dropped on an estimate: minima choose candidates, and full sets alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import materialize, slices, tidy
from pricetide.llm.components import components
from pricetide.llm.words import Texts, mix, signed

WORDS, BANDS, ROWS = 5, 30, 5
#: Documents with one rare shingle, or members of one head, that meet under one key.
BLOCK = 1000
#: Heads that are repeated, at most.
HEADS = 50_000


def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle."""
    prefix = texts.prefix()
    at = np.arange(max(0, texts.n - words + 1))
    hashes = texts.span(prefix, at, at + words)
    out = []
    for begin, end, n in zip(texts.begin.tolist(), texts.end.tolist(), texts.counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(hashes[begin : end - words + 1]))
        elif n:
            out.append(mix(texts.span(prefix, np.array([begin]), np.array([end])), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Universal hash minima of non-empty sets: (a * x + b) mod 2^64 with odd random a, high bits deciding."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, np.uint64)
    out = np.empty((len(sets), count), np.uint64)
    k = 0
    while k < len(sets):
        n, size = k, 0
        while n < len(sets) and (n == k or size + len(sets[n]) <= 16_384):
            size, n = size + len(sets[n]), n + 1
        x = mix(np.concatenate(sets[k:n]), 3)
        starts = np.cumsum([0, *map(len, sets[k : n - 1])])
        room = np.empty_like(x)
        for j in range(count):
            np.multiply(x, a[j], out=room)
            np.add(room, b[j], out=room)
            out[k:n, j] = np.minimum.reduceat(room, starts)
        k = n
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A fixed number of bytes per row."""
    raw = np.ascontiguousarray(rows)
    width = raw.dtype.itemsize * raw.shape[1]
    offsets = (np.arange(len(raw) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            sets = shingle_sets(Texts(part.column("_text"), lower=True), words)
            prints = np.array([[mix(s, 11).sum(dtype=np.uint64), mix(s, 12).sum(dtype=np.uint64)] for s in sets], np.uint64)
            some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
            keys, sketch = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), bands * rows), np.uint8)
            if len(some):
                least = minima([sets[k] for k in some], bands * rows)
                sketch[some] = mix(least) & np.uint64(255)
                folded = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    folded = mix(folded + least[:, r::rows], r)
                keys[some] = mix(folded + np.arange(bands, dtype=np.uint64), 9)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), pa.array(signed(prints[:, 0].copy())), pa.array(signed(prints[:, 1].copy())), _binary(keys), _binary(sketch)], names=["_id", "n", "p", "q", "bands", "sketch"])

    return docs.mapInArrow(run, "_id long, n long, p long, q long, bands binary, sketch binary")


def _exploded(reps: DataFrame) -> DataFrame:
    """(key, rep): a row per band."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw = part.column("bands").to_pylist()
            if raw:
                keys = np.frombuffer(b"".join(raw), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("rep").take(pa.array(np.repeat(np.arange(len(raw)), len(keys) // len(raw))))], names=["key", "rep"])

    return reps.select("rep", "bands").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, n, shingles) of the wanted documents, hashes as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            sets = shingle_sets(Texts(part.column("_text"), lower=True), words)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "shingles"])

    kept = docs.join(wanted.select(F.col("rep").alias("_id")), "_id", "left_semi")
    return kept.mapInArrow(run, "rep long, n long, shingles binary")


def _with_ends(pairs: DataFrame, ends: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of ``ends`` (by rep) for each end: ``x`` names those of a, ``y`` those of b.

    A head of very many members is repeated for blocks of these.  Such heads are few (``HEADS`` at most,
    as each has so large a part of all pairs), so their numbers of blocks are broadcast."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    columns = [c for c in ends.columns if c != "rep"]
    counts = pairs.groupBy("a").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(BLOCK, pairs.count() // HEADS))
    hot = F.broadcast(counts.select("a", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")))
    blocks = F.coalesce("_blocks", F.lit(1))
    mine = ends.select(F.col("rep").alias("b"), *(F.col(c).alias(k) for c, k in zip(columns, y, strict=True)))
    theirs = ends.select(F.col("rep").alias("a"), *(F.col(c).alias(k) for c, k in zip(columns, x, strict=True)))
    theirs = theirs.join(hot, "a", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    dealt = pairs.join(hot, "a", "left").withColumn("_block", F.pmod(F.xxhash64("b"), blocks).cast("int")).drop("_blocks")
    return dealt.join(mine, "b").join(theirs, ["a", "_block"]).drop("_block")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "y"):
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = _with_ends(pairs, sets.select("rep", "shingles"), ["x"], ["y"])
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _agreement(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets' sizes allow the similarity, with the number of equal minima, ``same``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array((x == y).sum(axis=1).astype(np.int32))], names=["a", "b", "same"])

    met = _with_ends(pairs, reps.select("rep", "sketch", "n"), ["x", "n"], ["y", "m"])
    sized = met.filter(_reaches(F.least("n", "m"), F.col("n"), F.col("m"), percent))
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same int")


def _reaches(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets of ``n`` and ``m`` shingles with ``both`` in common are similar enough."""
    return 100 * both >= percent * (n + m - both)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, df, rep, n, pos): the shingles in each set's prefix that other sets hold too.

    A set's order is by document frequency, then hash; ``pos`` counts from 0.  Of n shingles a partner
    must hold ceil(percent * n / 100), so the first n - that + 1 hold one of them."""

    @tidy
    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "shingles"):
            raw = part.column("shingles").to_pylist()
            lengths = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
            at = pa.array(np.repeat(np.arange(len(raw)), lengths))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), part.column("rep").take(at), part.column("n").take(at)], names=["shingle", "rep", "n"])

    rows = sets.mapInArrow(singles, "shingle long, rep long, n long")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = rows.join(shared, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    own = F.col("n") - F.size("s")
    room = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - own
    kept = ordered.select("rep", "n", own.alias("own"), F.posexplode(F.slice("s", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("at", "x"))
    return kept.select("x.shingle", "x.df", "rep", "n", (F.col("own") + F.col("at")).alias("pos"))


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in their prefixes and may be similar.

    ``placed``: shingle, df, rep, n, pos, comp.  A shingle of many documents is cut into blocks, and
    each pair of blocks is a key of its own."""
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    dealt = placed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    x = dealt.select("shingle", F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "pos", "comp")))
    y = dealt.select("shingle", F.explode(F.sequence(F.lit(0), "mine")).alias("i"), F.col("mine").alias("j"), *(F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "comp")))
    # what the sets can share if this is the first shingle of both orders that they share
    both = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    fits = (F.col("x_comp") != F.col("y_comp")) & ((F.col("i") < F.col("j")) | (F.col("x_rep") < F.col("y_rep"))) & _reaches(both, F.col("x_n"), F.col("y_n"), percent)
    return x.join(y, ["shingle", "i", "j"]).filter(fits).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of
    ``words``-word shingles (A-Z lower-cased).  ``component_id`` is the smallest id reachable and
    ``kept`` marks it.  Null, empty and blank texts have no shingles and no links; a text of fewer
    words is one shingle; equal texts are linked; rows of one id are one node; an id that is null
    or no integer comes out as null, has no component and is kept; other columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed_docs = materialize(_signatures(docs, words, bands, rows), "signatures")
    known = signed_docs.filter("n > 0 and _id is not null")
    classes = known.groupBy("p", "q", "n").agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = materialize(classes, "classes")

    heads = _exploded(reps).groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(_exploded(reps).join(heads, "key"), "buckets")
    wanted = members.select("rep").distinct()
    close = reps.join(wanted, "rep", "left_semi")
    sets = materialize(_sets(docs, wanted, words), "sets")
    pairs = members.filter("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    best = _agreement(pairs, close, percent).groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    equal = known.join(reps.select("p", "q", "n", "rep"), ["p", "q", "n"]).filter("_id <> rep").select(F.col("rep").alias("a"), F.col("_id").alias("b"))
    links = materialize(_confirmed(best, sets, percent), "confirmed")
    first = components(links)

    placed = members.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    placed = materialize(placed.join(open_keys, "key", "left_semi").select("rep", "comp").distinct(), "open")
    prefixes = _prefixes(sets.join(placed, "rep", "left_semi"), percent)
    more = materialize(_across(prefixes.join(placed, "rep"), percent), "across")
    links = links.unionByName(materialize(_confirmed(more, sets, percent), "confirmed")).unionByName(equal)

    final = components(links).select(F.col("node").alias("_id"), F.col("component"))
    out = signed_docs.select("_id", "n").join(final, "_id", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
