"""Tokens of two tokenizers over the same bytes, linked by sparse incidence matrices.

Row i of a token-byte matrix holds the bytes of token i.  Gustavson's row product of one tokenizer's
matrix with the other's transpose gives the overlap links: row i is the sum of the rows, one for each of
its bytes, that name the other side's tokens there.  Bytes at which tokens of both sides end cut
the text into groups, and the product of the token-group matrices gives the shared-group links.

Texts are worked on in units that start at a blank behind a visible character: no token of either
side reaches across.  Most units come again, so a worker aligns each once as long as it remembers it.

How often two ids are linked is counted over all documents.  A block of documents sends each
distinct pair once, with its number, and gets the corpus count back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import SLICE_BYTES, materialize, slices, texts_of, tidy

#: Texts of a block, in bytes (a longer text is a block of its own), and units of a generation a worker keeps.
BLOCK_BYTES, CACHE_UNITS = 8 << 20, 120_000
#: Units that go to the libraries as one text, and entries of a product that are held at once.
JOINED, PRODUCT_ENTRIES = 256, 1 << 20
#: A unit ends behind any visible character but the piece tokenizer's own sign for a blank.
_CUT = re.compile("(?<=[^\\s᠎▁])(?= )")


@dataclass(frozen=True)
class Csr:
    """A matrix of zeros and ones: row i has ones in columns ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        ends = np.cumsum(np.bincount(self.indices, minlength=self.width))
        return Csr(np.concatenate(([0], ends)), rows[np.argsort(self.indices, kind="stable")], len(self.indptr) - 1)


def product(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``a @ b``, for some rows of ``a`` at a time, in order.

    Row i is the sum of those rows of ``b`` that row i of ``a`` names."""
    sizes = np.diff(b.indptr)[a.indices]
    before = np.concatenate(([0], np.cumsum(sizes)))
    begin, rows = 0, len(a.indptr) - 1
    while begin < rows:
        room = before[a.indptr[begin]] + PRODUCT_ENTRIES
        end = max(begin + 1, int(np.searchsorted(before[a.indptr], room, side="right")) - 1)
        lo, hi = a.indptr[begin], a.indptr[end]
        named, size = a.indices[lo:hi], sizes[lo:hi]
        at = np.repeat(b.indptr[named] - (before[lo:hi] - before[lo]), size) + np.arange(before[hi] - before[lo])
        row = np.repeat(np.repeat(np.arange(begin, end), np.diff(a.indptr[begin : end + 1])), size)
        cells, values = np.unique(row * b.width + b.indices[at], return_counts=True)
        yield cells // b.width, cells % b.width, values
        begin = end


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens that follow each other."""
    indptr = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def token_groups(ends: np.ndarray, common: np.ndarray) -> Csr:
    """Tokens by groups; a group ends where tokens of both sides end."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(common, ends), len(common))


@dataclass(frozen=True)
class Alignment:
    """Two token sequences over the same bytes, by the bytes' numbers of each token."""

    a: np.ndarray
    b: np.ndarray

    @property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a), np.cumsum(self.b)

    @property
    def common(self) -> np.ndarray:
        return np.intersect1d(*self.ends, assume_unique=True)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, shared bytes)."""
        return product(token_bytes(self.a), token_bytes(self.b).transposed())

    def ending_together(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The overlaps of tokens that end at the same byte."""
        x, y = self.ends
        for i, j, n in self.overlaps():
            same = x[i] == y[j]
            yield i[same], j[same], n[same]

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, 1) within each group."""
        (x, y), common = self.ends, self.common
        return product(token_groups(x, common), token_groups(y, common).transposed())


#: Kinds of links between tokens.
KINDS = {"overlap": Alignment.overlaps, "end": Alignment.ending_together, "group": Alignment.shared_groups}


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the
    others follow from 256 on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in chain(zip(plain, plain, strict=True), zip(range(256, 512), other, strict=False))}


class _Side:
    """A tokenizer's ids for texts, and the bytes of each id."""

    def __init__(self, spellings: list[bytes]):
        self.spellings = spellings
        self.sizes = np.fromiter(map(len, spellings), np.int64, len(spellings))

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevelSide(_Side):
    """Byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        special, byte = set(self.tok.get_added_tokens_decoder()), _byte_level()
        entries = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        super().__init__([x.encode() if i in special else bytes(byte[c] for c in x) for i, x in enumerate(entries)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide(_Side):
    """A sentencepiece model that puts a blank before each text; texts are given with that blank."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = self.sp.piece_to_id("▁")
        pieces = [(i, self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())]
        super().__init__([bytes([int(x[3:-1], 16)]) if self.sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the library gives no token at all for the empty text
        return [ids if t != " " else [self.blank] for t, ids in zip(texts, self.sp.encode([t[1:] for t in texts], num_threads=1), strict=True)]


def units_of(text: str | None) -> list[str]:
    """A blank and the text, cut where no token of either side can reach across."""
    return _CUT.split(" " + text) if text else []


@dataclass(frozen=True)
class Units:
    """Tokens of many units in a row: flat ids and each unit's number of them, for both sides."""

    units: list[str]
    ids: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray]


class Aligner:
    """Both tokenizers of a worker, and what it remembers of units in two generations."""

    def __init__(self, a: str, b: str, limit: int = CACHE_UNITS):
        self.sides = (ByteLevelSide(a), PieceSide(b))
        self.names = [[str(i).encode() + s for i in range(max(len(x.spellings) for x in self.sides))] for s in (b"", b",", b"|", b";")]
        self.limit, self.young, self.old = limit, {}, {}

    def _cut(self, side: _Side, texts: list[list[str]]) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
        """Ids and numbers of tokens by unit of each text, given as its units; None where the tokens do not
        have the text's bytes or reach across units."""
        ids, counts = [], []
        for units, got in zip(texts, side.encode(["".join(u) for u in texts]), strict=True):
            own = np.array(got, np.int64)
            raw = [u.encode() for u in units]
            same = b"".join(map(side.spellings.__getitem__, got)) == b"".join(raw)
            ends = np.cumsum(side.sizes[own])
            wanted = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            last = np.searchsorted(ends, wanted)
            same = same and bool((ends[last] == wanted).all())
            ids.append(own if same else None)
            counts.append(np.diff(last, prepend=-1) if same else None)
        return ids, counts

    def tokens(self, units: list[str]) -> Units:
        """The units that both sides can spell, with their tokens.  Units whose end is a cut are joined to
        texts of many, which have the same tokens; where that is not so, they go one by one."""
        joinable = [u for u in units if _CUT.search(u[-1] + " ")]
        texts = [joinable[k : k + JOINED] for k in range(0, len(joinable), JOINED)]
        texts += [[u] for u in units if not _CUT.search(u[-1] + " ")]
        kept, ids, counts = [], ([], []), ([], [])
        while texts:
            parts = [self._cut(side, texts) for side in self.sides]
            again = []
            for k, own in enumerate(texts):
                if all(p[0][k] is not None for p in parts):
                    kept += own
                    for s, p in enumerate(parts):
                        ids[s].append(p[0][k])
                        counts[s].append(p[1][k])
                elif len(own) > 1:
                    again += [[u] for u in own]
            texts = again
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return Units(kept, (flat(ids[0]), flat(ids[1])), (flat(counts[0]), flat(counts[1])))

    def _learn(self, units: list[str]) -> None:
        got = self.tokens(units)
        (a, b), (n_a, n_b) = got.ids, got.counts
        self.young.update(dict.fromkeys(set(units).difference(got.units)))  # those have no tokens
        if not got.units:
            return
        aligned = Alignment(self.sides[0].sizes[a], self.sides[1].sizes[b])
        (x, y), common = aligned.ends, aligned.common
        links = [(i, j) for i, j, _ in aligned.ending_together()]
        i, j = (np.concatenate([p[k] for p in links]) for k in (0, 1))
        pairs = a[i] << 32 | b[j]
        pair_unit = np.repeat(np.arange(len(n_a)), n_a)[i]
        pair_ends = np.cumsum(np.bincount(pair_unit, minlength=len(n_a)))
        group_a, group_b = (token_groups(e, common).indices for e in (x, y))
        per_a, per_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        # all tokens in the order of the written groups, each with the sign behind it
        place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.ones(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        sign[np.cumsum(per_a + per_b) - 1] = 3
        sign[np.cumsum(per_a + per_b) - per_b - 1] = 2
        ends = np.cumsum(n_a + n_b)
        sign[ends - 1] = 0
        words = [self.names[s][k] for s, k in zip(sign.tolist(), ids.tolist(), strict=True)]
        n_groups = np.diff(np.searchsorted(common, x[np.cumsum(n_a) - 1], side="right"), prepend=0)
        raw = pairs.astype("<i8").tobytes()
        fields = zip(got.units, [0, *ends.tolist()], ends.tolist(), [0, *(8 * pair_ends).tolist()], (8 * pair_ends).tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=False)
        self.young.update((u, (b"".join(words[p:q]), raw[v:w], k, m, g)) for u, p, q, v, w, k, m, g in fields)

    def documents(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int, int, int] | None]:
        """For each text: its groups as written, its pairs of ids, numbers of tokens and groups; None where
        a text is empty or the tokens do not have its bytes."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        units = [units_of(t) for t in texts]
        unknown = set().union(*units).difference(self.young)
        self.young.update((u, self.old[u]) for u in unknown if u in self.old)
        if unknown := [u for u in unknown if u not in self.young]:
            self._learn(unknown)
        for own in units:
            found = list(map(self.young.__getitem__, own))
            if not found or None in found:
                yield None
                continue
            groups, pairs, n_a, n_b, n_groups = zip(*found, strict=True)
            yield b";".join(groups), b"".join(pairs), sum(n_a), sum(n_b), sum(n_groups)


@cache
def aligner(a: str, b: str) -> Aligner:
    """One per worker process."""
    return Aligner(a, b)


def links(df: DataFrame, a: str, b: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, j, a_id, b_id, weight): a row for each link of each text.

    i and j number the text's tokens of either side.  Kind "overlap": the tokens share ``weight`` bytes;
    "end": those of them that end together; "group": tokens of one group, weight 1.  Rows leave in bounded batches, even
    from a group of very many tokens.  Texts without tokens have no rows, see ``align``."""
    make, out_kind = KINDS[kind], df.schema[id_col].dataType
    out = T.StructType().add(id_col, out_kind).add("i", T.LongType()).add("j", T.LongType()).add("a_id", T.LongType()).add("b_id", T.LongType()).add("weight", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for part in slices(batches, "text"):
            for k, text in enumerate(texts_of(part, "text")):
                units = units_of(text)
                got = own.tokens(list(dict.fromkeys(units)))
                if not units or len(got.units) < len(set(units)):
                    continue
                cuts = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in zip(got.ids, got.counts, strict=True)]
                at = {u: x for x, u in enumerate(got.units)}
                x, y = (np.concatenate([c[at[u]] for u in units]) for c in cuts)
                for i, j, weight in make(Alignment(own.sides[0].sizes[x], own.sides[1].sizes[y])):
                    ids = part.column("id").take(pa.array(np.full(len(i), k)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(i), pa.array(j), pa.array(x[i]), pa.array(y[j]), pa.array(weight)], names=out.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per block of documents: their ids, numbers and digests, the block's distinct pairs by falling
    frequency (``pairs``, ``n``), and each document's pairs as places in these (``low``, ``high``), with multiplicities."""
    kind = docs.schema["id"].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def block(number: int, ids: list[pa.Array], found: list[tuple | None]) -> pa.RecordBatch:
        sizes = np.array([len(f[1]) // 8 if f else 0 for f in found], np.int64)
        flat = np.frombuffer(b"".join(f[1] for f in found if f), "<i8")
        pairs, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cells, times = np.unique(np.repeat(np.arange(len(found)), sizes) * max(1, len(pairs)) + rank[inverse], return_counts=True)
        fits = -(-times // 255)  # a byte each
        cells, times = np.repeat(cells, fits), np.minimum(255, np.repeat(times, fits) - 255 * (np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)))
        doc, place = cells // max(1, len(pairs)), cells % max(1, len(pairs))
        numbers = np.array([f[2:] if f else (0, 0, 0) for f in found], np.int32)
        digests = b"".join(hashlib.sha256(f[0]).digest() if f else bytes(32) for f in found)
        raws = [numbers, np.bincount(doc, minlength=len(found)).astype(np.int32), (place & 0xFFFF).astype(np.uint16), (place >> 16).astype(np.uint16), times.astype(np.uint8), pairs[order], n[order]]
        own = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.concat_arrays(ids)).cast(arrow)
        return pa.RecordBatch.from_arrays([pa.array([number]), own, pa.array([digests], pa.binary()), *(pa.array([np.ascontiguousarray(r).tobytes()], pa.binary()) for r in raws)], names=out.names)

    out = T.StructType().add("block", T.LongType()).add("ids", T.ArrayType(kind))
    for c in ("digests", "numbers", "sizes", "low", "high", "times", "pairs", "n"):
        out = out.add(c, T.BinaryType())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a, b), TaskContext.get().partitionId() << 32
        ids, found, size = [], [], 0
        for part in slices(batches, "text", SLICE_BYTES):
            ids.append(part.column("id"))
            found += own.documents(texts_of(part, "text"))
            size += part.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield block(number, ids, found)
                ids, found, size, number = [], [], 0, number + 1
        if found:
            yield block(number, ids, found)

    return docs.mapInArrow(run, out)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, n): a row for each distinct pair of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "n")), strict=True):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(n)], names=["block", "place", "pair", "n"])

    return blocks.select("block", "pairs", "n").mapInArrow(run, "block long, place int, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair of ids in the corpus, and whether no pair of its b id has more.

    A pair comes once per block, so no key has a large part of the rows."""
    totals = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = totals.groupBy("b_id").agg(F.max("total").alias("most"))
    return totals.join(most, "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``df``.

    ``a`` is a byte-level vocabulary of the tokenizers library, ``b`` a sentencepiece model; both see a
    blank and the text.  Links are pairs of tokens that end together; a pair of ids counts as often as it is
    linked in the whole corpus.  n_best: links whose pair has the highest count of its b id, ties included;
    count_sum: the counts of all links; groups_sha256: digest of the groups, ids by commas, sides by ``|``,
    groups by ``;``.  A text that is null, empty or not reproduced by the bytes of either side's tokens
    has no tokens: zeros and an empty digest.  Each row stands for itself, also with equal or null ids; other columns
    are not read; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType().add(id_col, kind)
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out = out.add(c, T.LongType())
    out = out.add("groups_sha256", T.StringType())
    blocks = materialize(_blocks(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), a, b), "blocks")
    pairs = _pairs(blocks)
    answers = pairs.drop("n").join(pair_counts(pairs), "pair").select("block", "place", "total", "best")
    texts = blocks.drop("pairs", "n")

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: rows.column(c)[0] for c in rows.column_names}
        of = lambda c, t: np.frombuffer(row[c].as_py(), t)
        numbers, ends = of("numbers", np.int32).reshape(-1, 3).astype(np.int64), np.cumsum(of("sizes", np.int32))
        place = of("low", np.uint16).astype(np.int64) | of("high", np.uint16).astype(np.int64) << 16
        times = of("times", np.uint8).astype(np.int64)
        total, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found.column("place").to_numpy()
        total[at], best[at] = found.column("total").to_numpy(), found.column("best").to_numpy()

        def sums(x: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])

        digests = of("digests", np.uint8).tobytes().hex()
        texts = [digests[64 * k : 64 * k + 64] if n else "" for k, n in enumerate(numbers[:, 0].tolist())]
        columns = [*(np.ascontiguousarray(c) for c in numbers.T), sums(times), sums(times * best[place]), sums(times * total[place])]
        return pa.table([row["ids"].values, *(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.string())], names=out.names)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)
