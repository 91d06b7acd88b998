"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history).  The class softmax has features of
the last word, the word before it (skip) and the hash of both (n-gram), over units of fixed number.
Frequent words are cut into classes of equal mass, the others are put in classes by their ending.

Within a class every word has features with the skip word, the last word and both, by the words' own
hashes.  They enter one after the other, each with its own normalizer: p becomes
p exp(weight) / Z = (n(context, word) + a p) / (n(context, class) + a), starting from smoothed counts.
So weights are closed forms of the training counts (zero for pairs not met), and the sum over a
class of any size is one without going through it.

The passes over the corpus: (1) texts become codes of their block's own words, written packed, with
the words' hashes and counts cut into ranges; (2) these ranges of all blocks meet for corpus counts, which
go back to the blocks; (3) one context after the other, blocks send their distinct features with counts, packed, to parts
of the feature table, whose corpus counts are written, so that no two contexts' features are on disk at once; (4) blocks get
these counts back; codes become counts, scores within classes and unit sequences, written again; (5) each task runs gradient steps
over its training documents and the tasks' weights are averaged feature by feature; (6) scoring.
Only the list of the most frequent words, class totals and weights, all of fixed size, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import FREED, give_back, materialize, slices

TOP, TOP_CLASSES, ENDINGS, NGRAMS = 2048, 16, 16, 2048
CLASSES = TOP_CLASSES + ENDINGS
UNITS = TOP + ENDINGS
#: Rows of the weight table: bias, last word, word before it, both hashed.
ROWS = 1 + 2 * UNITS + NGRAMS
#: Text bytes that share a word list.
BLOCK_BYTES = 16 << 20
#: Text bytes for each part of the words, whose counts are added in one task.
PART_BYTES = 8 << 20
_CODED = "block long, part int, n long, ids binary, none binary, lengths binary, codes binary, sizes binary, hashes binary, endings binary, counts binary"
#: Not a word, so it can stand for the end of a text.
_END = b"\n"
_STEP = 8192
#: Weight of the distribution so far against the counts of a context: skip word, last word, both.
PRIOR = (200.0, 10.0, 5.0)
#: The feature table grows with the training tokens: hash values for each, and tokens of a part.
KEYS_A_TOKEN, PART_TOKENS = 1 << 10, 1 << 21
#: Tokens of a block whose features are in memory at once (and one document more), and tokens hashed at once.
FEATURE_TOKENS, _HASHED = 1 << 22, 1 << 18


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _pack(x: np.ndarray, size: int = 4) -> bytes:
    """Unsigned values of ``size`` bytes as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, size: int = 4) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}")[:, 0]


def _grouped(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of unsigned values below 2^bits in ascending order of the values, and which of them begin a new value.

    Where value and place fit in one number, sorting these is all.
    """
    of = len(x).bit_length()
    if bits + of <= 64:
        both = np.sort(x << np.uint64(of) | np.arange(len(x), dtype=np.uint64))
        by, x = (both & np.uint64((1 << of) - 1)).view(np.int64), both >> np.uint64(of)
    else:
        by = np.argsort(x)
        x = x[by]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return by, new


def _spread(values: np.ndarray, by: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Values of the distinct numbers, ascending, as values of all; the rest as ``_grouped`` gives it."""
    out = np.empty(len(by), values.dtype)
    out[by] = values[np.cumsum(new) - 1]
    return out


def _by_size(sizes: np.ndarray) -> np.ndarray:
    """Places of a block's words, in order of their hashes, by code: frequent ones have small codes."""
    return np.argsort(-sizes.astype(np.int16), kind="stable")


def _sorted_hashes(raw: Iterable[bytes], sizes: Iterable[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_unpack(x, n, 8), dtype=np.uint64) for x, n in zip(raw, sizes, strict=True))])


def _pieces(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers: number, begin and end."""
    first = np.flatnonzero(np.diff(parts.view(np.int64), prepend=-1))
    yield from zip(parts[first].tolist(), first, np.append(first[1:], len(parts)), strict=True)


def _coded(docs: DataFrame, part_bits: int) -> DataFrame:
    """Rows of two kinds: a block's documents as codes, and (with ``part``) a part of its words.

    Codes number the block's words by the magnitude of their count in it (``sizes``), then by hash, so
    that most are small and pack well; parts are ranges of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, size = TaskContext.get().partitionId() << 24, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            ids, none, lengths, own, endings, inner = (list(x) for x in zip(*found, strict=True))
            own, ending = np.concatenate(own), np.concatenate(endings)
            by, new = _grouped(own)
            hashes, ending = own[by[new]], ending[by[new]]
            place = _spread(np.arange(len(hashes), dtype=np.uint32), by, new)
            starts = np.cumsum([0, *map(len, endings)])
            codes = np.concatenate([place[a:][x] for a, x in zip(starts, inner, strict=False)])
            ids, none, lengths = map(np.concatenate, (ids, none, lengths))
            trained = np.bincount(codes[np.repeat(_trained(ids, none), lengths)], minlength=len(hashes))
            sizes = np.log2(np.bincount(codes, minlength=len(hashes))).astype(np.uint8)
            rank = np.empty(len(hashes), np.uint32)
            rank[_by_size(sizes)] = np.arange(len(hashes), dtype=np.uint32)
            rows = [(block, None, len(hashes), ids.tobytes(), none.tobytes(), lengths.tobytes(), _pack(rank[codes]), _pack(sizes, 1), None, None, None)]
            for part, a, b in _pieces(hashes >> np.uint64(1) >> np.uint64(63 - part_bits)):
                rows.append((block, part, b - a, None, None, None, None, None, _pack(np.diff(hashes[a:b], prepend=np.uint64(0)), 8), ending[a:b].tobytes(), _pack(trained[a:b], 8)))
            types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=_CODED.replace(",", "").split()[::2])

        for part in slices(batches, "_text", 1 << 21):
            raw = part.column("_text").cast(pa.binary()).to_pylist()
            words, lengths = [], np.empty(len(raw), np.int64)
            for k, t in enumerate(raw):
                before = len(words)
                words += t.lower().split() if t else []
                words.append(_END)
                lengths[k] = len(words) - before
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            by, new = _grouped(hashes)
            first = by[new]
            inner = _spread(np.arange(len(first), dtype=np.uint32), by, new)
            endings = np.fromiter((zlib.crc32(words[k][-2:]) % ENDINGS for k in first.tolist()), np.uint8, len(first))
            ids = part.column("_id")
            found.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), lengths, hashes[first], endings, inner))
            size += part.column("_text").nbytes
            if size >= BLOCK_BYTES:
                yield from done()
                block, found, size = block + 1, [], 0
        if found:
            yield from done()

    return docs.mapInArrow(run, _CODED)


def _trained(ids: np.ndarray, none: np.ndarray) -> np.ndarray:
    return np.array([not (x or held_out(i)) for i, x in zip(ids.tolist(), none.tolist(), strict=True)], bool)


def _counts(coded: DataFrame) -> DataFrame:
    """Corpus counts of each block's words (kind 0), and of each part of the words the most
    frequent (kind 1) and the sums by ending (kind 2)."""
    names = ["kind", "block", "part", "n", "totals", "hash", "ending", "c", "v"]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        sizes, part = pdf["n"].to_numpy(np.int64), int(pdf["part"].iat[0])
        hashes = _sorted_hashes(pdf["hashes"], sizes)
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpack(x, n, 8) for x, n in zip(pdf["counts"], sizes, strict=True)])).astype(np.int64)
        ending = np.frombuffer(b"".join(pdf["endings"]), np.uint8)[first].astype(np.int64)
        ends, own = np.cumsum(sizes), own.view(np.int64)
        rows = [(0, block, part, n, _pack(total[at[z - n : z]], 8), 0, 0, 0, 0) for block, n, z in zip(pdf["block"], sizes, ends, strict=True)]
        known = np.flatnonzero(total)
        for k in known[np.lexsort((own[known], -total[known]))][:TOP]:
            rows.append((1, 0, part, 0, b"", own[k], ending[k], total[k], 1))
        for e in np.unique(ending[known]):
            of = known[ending[known] == e]
            rows.append((2, 0, part, 0, b"", 0, e, total[of].sum(), len(of)))
        return pd.DataFrame(rows, columns=names)

    words = coded.filter("part is not null").select("block", "part", "n", "hashes", "endings", "counts")
    return words.groupBy("part").applyInPandas(add, "kind int, block long, part int, n long, totals binary, hash long, ending int, c long, v long")


class Tables:
    """What of the corpus the driver knows: totals, the most frequent words, classes."""

    def __init__(self, counts: DataFrame):
        """``counts``: rows of ``_counts``."""
        top = counts.filter("kind = 1").orderBy(F.desc("c"), "hash").limit(TOP).collect()
        per = counts.filter("kind = 2").groupBy("ending").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()  # at most ENDINGS rows
        self.total, self.distinct = sum(r.c for r in per), sum(r.v for r in per)
        mass = np.cumsum([r.c for r in top]) if top else np.zeros(0)
        self.class_of_unit = np.concatenate([np.minimum((mass - 1) * TOP_CLASSES // max(1, mass[-1]) if len(mass) else mass, TOP_CLASSES - 1).astype(np.int64), np.zeros(TOP - len(top), np.int64), TOP_CLASSES + np.arange(ENDINGS)])
        found = np.array([r.hash for r in top], np.int64).view(np.uint64)
        self.top_units = np.argsort(found)
        self.top_hashes = found[self.top_units]
        self.end_unit = next((k for k, h in enumerate(found.tolist()) if h == xxhash.xxh3_64_intdigest(_END)), 0)
        self.class_c, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in per:
            self.class_c[TOP_CLASSES + r.ending] += r.c
            self.class_v[TOP_CLASSES + r.ending] += r.v
        for k, r in enumerate(top):
            for side, sign in ((TOP_CLASSES + r.ending, -1), (self.class_of_unit[k], 1)):
                self.class_c[side] += sign * r.c
                self.class_v[side] += sign

    def units(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = TOP + endings.astype(np.int64)
        if len(self.top_hashes):
            at = np.minimum(np.searchsorted(self.top_hashes, hashes), len(self.top_hashes) - 1)
            out = np.where(self.top_hashes[at] == hashes, self.top_units[at], out)
        return out.astype(np.uint16)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + y
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def _key_bits(tokens: int) -> tuple[int, int]:
    """Bits of a feature's hash and of the number of its part; what is left is at most 31 bits."""
    grown = max(1, tokens - 1).bit_length()
    return grown + KEYS_A_TOKEN.bit_length() - 1, max(0, grown + 1 - PART_TOKENS.bit_length())


def _keys(codes: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, classes: np.ndarray, bits: int, contexts: Iterable[int]) -> Iterator[np.ndarray]:
    """Hashes of each token's features in the given contexts (skip word, last word, both): with the word, then with its class."""
    hashes = np.append(hashes, np.uint64(xxhash.xxh3_64_intdigest(_END)))
    begins = np.cumsum(lengths) - lengths
    last, skip = np.roll(codes, 1), np.roll(codes, 2)
    last[begins] = skip[begins] = len(hashes) - 1
    skip[begins[lengths > 1] + 1] = len(hashes) - 1

    def of(context: int, by_class: bool) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        for a in range(0, len(codes), _HASHED):
            at = slice(a, a + _HASHED)
            target = classes[codes[at]].astype(np.uint64) if by_class else hashes[codes[at]]
            history = _mixed(hashes[skip[at]], hashes[last[at]]) if context == 2 else hashes[(skip, last)[context][at]]
            out[at] = _mixed(history, target) >> np.uint64(64 - bits)
        return out

    for context in contexts:
        yield of(context, False)
        yield of(context, True)


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Slices of a block's documents: number, begin and end."""
    at = (np.cumsum(lengths) - lengths) // FEATURE_TOKENS
    first = np.flatnonzero(np.diff(at, prepend=-1))
    yield from zip(range(len(first)), first, np.append(first[1:], len(at)), strict=True)


class _Block:
    """A block's documents: ids, whether in training, lengths, codes; by code: hash, count, unit, class."""

    def __init__(self, pdf: pd.DataFrame, t: Tables):
        row = pdf[pdf["codes"].notna()].iloc[0]
        words, totals = (pdf[pdf[c].notna()].sort_values("part") for c in ("hashes", "totals"))
        self.number = int(row["block"])
        self.ids, self.none, self.lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool), np.frombuffer(row["lengths"], np.int64)
        self.trained = _trained(self.ids, self.none)
        self.ends = np.concatenate(([0], np.cumsum(self.lengths)))
        self.codes = _unpack(row["codes"], int(self.ends[-1]))
        order = _by_size(_unpack(row["sizes"], int(row["n"]), 1))
        self.hashes = _sorted_hashes(words["hashes"], map(int, words["n"]))[order]
        self.c = np.concatenate([_unpack(x, int(n), 8) for x, n in zip(totals["totals"], totals["n"], strict=True)])[order]
        self.unit = t.units(self.hashes, np.frombuffer(b"".join(words["endings"]), np.uint8)[order])
        self.classes = t.class_of_unit[self.unit]

    def keys(self, begin: int, end: int, bits: int, contexts: Iterable[int] = range(len(PRIOR))) -> Iterator[np.ndarray]:
        return _keys(self.codes[self.ends[begin] : self.ends[end]], self.lengths[begin:end], self.hashes, self.classes, bits, contexts)


def _feature_counts(blocks: DataFrame, t: Tables, context: int) -> DataFrame:
    """(block, cut, kind, part, n, totals): corpus counts of the distinct features of a block's slice in one context,
    in order of their hashes; kinds are numbered through all contexts."""
    bits, part_bits = _key_bits(t.total)
    low = np.uint64(bits - part_bits)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        of, out = _Block(pdf, t), []
        for cut, begin, end in _cuts(of.lengths):
            flags = np.repeat(of.trained[begin:end], of.lengths[begin:end])
            for kind, keys in enumerate(of.keys(begin, end, bits, [context]), 2 * context):
                keys <<= np.uint64(1)
                keys |= flags
                keys.sort()
                counted = (keys & np.uint64(1)).astype(bool)
                keys >>= np.uint64(1)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                counts = np.add.reduceat(counted, first, dtype=np.uint32)
                keys = keys[first]
                for part, a, b in _pieces(keys >> low):
                    own = keys[a:b] & ((np.uint64(1) << low) - np.uint64(1))
                    out.append((of.number, cut, kind, part, b - a, _pack(np.diff(own, prepend=np.uint64(0))), _pack(counts[a:b])))
        give_back()
        return pd.DataFrame(out, columns=["block", "cut", "kind", "part", "n", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["n"].to_numpy(np.int64)
        keys = np.concatenate([np.cumsum(_unpack(x, n), dtype=np.uint32) for x, n in zip(pdf["keys"], sizes, strict=True)])
        counts = np.concatenate([_unpack(x, n) for x, n in zip(pdf["counts"], sizes, strict=True)])
        by, new = _grouped(keys.astype(np.uint64), 32)
        # counts stay below 2^32, more tokens than a part of a context can hold
        totals = _spread(np.minimum(np.add.reduceat(counts[by], np.flatnonzero(new), dtype=np.int64), 2**32 - 1).astype(np.uint32), by, new)
        ends = np.cumsum(sizes)
        return pdf[["block", "cut", "kind", "part", "n"]].assign(totals=[_pack(totals[a:b]) for a, b in zip(ends - sizes, ends, strict=True)])

    sent = blocks.groupBy("block").applyInPandas(send, "block long, cut int, kind int, part int, n int, keys binary, counts binary")
    return sent.groupBy("kind", "part").applyInPandas(add, "block long, cut int, kind int, part int, n int, totals binary")


def _within(p: np.ndarray, counts: Iterator[np.ndarray]) -> np.ndarray:
    """p(word | class, history) of each token: ``p`` without history, changed by each context's counts."""
    for a, n_word, n_class in zip(PRIOR, counts, counts, strict=False):
        p = (np.minimum(n_word, n_class) + a * p) / (n_class + a)
    return p


def _sequences(coded: DataFrame, counts: DataFrame, t: Tables) -> DataFrame:
    """Per document: counts, base score, the within-class part of the score, and units (uint16 bytes)."""
    total, distinct = t.total, t.distinct
    bits, _ = _key_bits(total)

    def run(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        of = _Block(pdf, t)
        places = table.sort_values(["cut", "kind", "part"]).groupby(["cut", "kind"])

        def totals(cut: int, begin: int, end: int) -> Iterator[np.ndarray]:
            for kind, keys in enumerate(of.keys(begin, end, bits)):
                own = places.get_group((cut, kind))
                found = np.concatenate([_unpack(x, n) for x, n in zip(own["totals"], own["n"], strict=True)])
                yield _spread(found, *_grouped(keys, bits))

        begins, codes, c = of.ends[:-1], of.codes, of.c.astype(np.float64)
        base = np.log10((c + 1) / (total + distinct + 1))
        alone = (c + 1) / (t.class_c[of.classes] + t.class_v[of.classes] + 1)
        within = np.concatenate([np.log10(_within(alone[codes[of.ends[x] : of.ends[y]]], totals(k, x, y))) for k, x, y in _cuts(of.lengths)])
        units = of.unit[codes]
        sums = {"n_tokens": of.lengths, "n_known": np.add.reduceat((c > 0).astype(np.int64)[codes], begins), "base": np.add.reduceat(base[codes], begins), "within": np.add.reduceat(within, begins)}
        out = pd.DataFrame({"_id": pd.Series(of.ids).astype("Int64").mask(of.none), "held": ~of.trained, **sums, "units": [units[a : a + n].tobytes() for a, n in zip(begins, of.lengths, strict=True)]})
        give_back()
        return out

    docs = coded.drop("counts")
    totals = counts.filter("kind = 0").select("block", "part", "n", "totals")
    blocks = docs.unionByName(totals, allowMissingColumns=True)
    found = [materialize(_feature_counts(blocks, t, k), f"features{k}", FREED) for k in range(len(PRIOR))]
    found = reduce(DataFrame.unionByName, found)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, "_id long, held boolean, n_tokens long, n_known long, base double, within double, units binary")


def _features(raw: list[bytes], end_unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, three weight rows of each token, and the texts' ends."""
    units = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
    ends = np.cumsum([len(x) // 2 for x in raw])
    last, skip = np.roll(units, 1), np.roll(units, 2)
    begins = np.concatenate(([0], ends[:-1]))
    last[begins] = skip[begins] = end_unit
    skip[begins[begins + 1 < len(units)] + 1] = end_unit
    both = ((last * 40_503 + skip * 9_973 + 12_345) * 2_654_435_761 >> 16) % NGRAMS
    return units, np.stack([1 + last, 1 + UNITS + skip, 1 + 2 * UNITS + both]), ends


def _class_scores(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of all classes, for each token."""
    z = w.take(rows[0], axis=0)
    for row in rows[1:]:
        z += w.take(row, axis=0)
    z += w[0]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(sequences: DataFrame, t: Tables, rate: float = 0.3) -> np.ndarray:
    """Weights after one pass of gradient steps over all training documents, averaged over tasks."""
    start = np.zeros((ROWS, CLASSES), np.float32)
    start[0] = np.log((t.class_c + 1) / (t.total + CLASSES))
    unit_class, end_unit = t.class_of_unit, t.end_unit
    columns = [f"w{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, squares, visits = start.copy(), np.full(ROWS, 1e-3, np.float32), np.zeros(ROWS, np.int64)
        for part in slices(batches, "units", 1 << 19):
            units, rows, _ = _features(part.column("units").to_pylist(), end_unit)
            for k in range(0, len(units), _STEP):
                r = rows[:, k : k + _STEP]
                miss = np.exp(_class_scores(w, r))
                miss[np.arange(r.shape[1]), unit_class[units[k : k + _STEP]]] -= 1
                for each in r:
                    by = np.argsort(each, kind="stable")
                    first = np.flatnonzero(np.diff(each[by], prepend=-1))
                    which, n = each[by][first], np.diff(np.append(first, len(by)))
                    g = np.add.reduceat(miss[by], first) / np.sqrt(n)[:, None]
                    squares[which] += (g**2).mean(axis=1)
                    w[which] -= rate / np.sqrt(squares[which])[:, None] * g
                    visits[which] += n
        seen = np.flatnonzero(visits)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(visits[seen]), *(pa.array(w[seen, k].astype(np.float32)) for k in range(CLASSES))], names=["row", "n", *columns])

    steps = sequences.filter("not held").select("units").mapInArrow(run, "row long, n long, " + ", ".join(f"{c} float" for c in columns))
    mean = steps.groupBy("row").agg(*((F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns))
    for r in mean.collect():  # at most ROWS rows
        start[r.row] = r[1:]
    return start


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents whose crc32(id as text) mod 7 is not 2; an id that is null or no
    integer comes out as null and is held out.  Null,
    empty and blank texts are the end token alone.  Repeated rows count as often as they come;
    other columns are not read; an empty table gives no rows; without training documents the
    class softmax is uniform.
    """
    docs = df.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    coded = materialize(_coded(docs, min(24, (int(size) // PART_BYTES).bit_length())), "coded")
    counts = materialize(_counts(coded), "counts", FREED)
    t = Tables(counts)
    sequences = materialize(_sequences(coded, counts, t), "sequences", FREED)
    w, unit_class, end_unit, total = fit(sequences, t), t.class_of_unit, t.end_unit, t.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "units", 1 << 19):
            units, rows, ends = _features(part.column("units").to_pylist(), end_unit)
            logs = np.empty(len(units))
            for k in range(0, len(units), _STEP):
                found = _class_scores(w, rows[:, k : k + _STEP])
                logs[k : k + _STEP] = found[np.arange(len(found)), unit_class[units[k : k + _STEP]]]
            sums = np.add.reduceat(logs, np.concatenate(([0], ends[:-1]))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "held", "n_tokens", "n_known", "base")), pa.array(part.column("within").to_numpy() + sums)], names=["_id", "held", "n_tokens", "n_known", "base", "score"])

    scored = sequences.mapInArrow(run, "_id long, held boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(F.col("_id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
