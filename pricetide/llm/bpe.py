"""Byte-pair encoding with forced boundaries, and decoding.

Two neighbouring bytes that no vocabulary token holds side by side can never be merged, so a
word may be cut there and its fragments encoded on their own.  Fragments of many words are
merged together in numpy: in each round every fragment merges its first pair of lowest rank.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from pricetide.llm.common import slices, texts_of, tidy
from pricetide.llm.tokens import WordCache, is_simple

#: Longer fragments are merged one by one, with a heap.
WIDE = 64
_NEVER = np.int32(2**31 - 1)
_PAD = 65535


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the other bytes for the letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizer file says: symbols, merge ranks, forced boundaries, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        if size > _PAD:
            raise ValueError("vocabularies of up to 65,535 ids are supported")
        self.strings = [""] * size
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = s
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretoken = regex.compile(split["pattern"]["Regex"])
        self.pretoken_or_end = regex.compile("\n|" + split["pattern"]["Regex"])
        self.first = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        keys = np.array([self.vocab[a] << 16 | self.vocab[b] for a, b in merges], np.uint32)
        self.ranks = {int(k): r for r, k in reversed(list(enumerate(keys.tolist())))}
        self._tables(np.fromiter(self.ranks, np.uint32), np.fromiter(self.ranks.values(), np.int32))
        of = self.byte_of = {c: b for b, c in letters.items()}
        self.inside = np.zeros((256, 256), bool)
        for s in self.vocab:
            raw = [of[c] for c in s.removesuffix(self.suffix)]
            self.inside[raw[:-1], raw[1:]] = True

    def _tables(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Hash tables without chains: what finds its slot taken goes to the next, smaller table."""
        self.tables, bits, factor = [], 20, 2654435761
        while len(keys):
            slot = (keys * np.uint32(factor & 0xFFFFFFFF)) >> np.uint32(32 - bits)
            _, take = np.unique(slot, return_index=True)
            table, values = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, _NEVER, np.int32)
            table[slot[take]], values[slot[take]] = keys[take], ranks[take]
            self.tables.append((np.uint32(factor & 0xFFFFFFFF), np.uint32(32 - bits), table, values))
            keep = np.ones(len(keys), bool)
            keep[take] = False
            keys, ranks, bits, factor = keys[keep], ranks[keep], max(12, bits - 5), factor * 40503 + 2

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        out = np.full(keys.shape, _NEVER, np.int32)
        for factor, shift, table, values in self.tables:
            slot = (keys * factor) >> shift
            out = np.minimum(out, np.where(table[slot] == keys, values[slot], _NEVER))
        return out

    def merge(self, s: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded at the right, with all merges done."""
        out = np.full(s.shape, _PAD, np.int32)
        rows, ranks = np.arange(len(s)), self.rank(s[:, :-1], s[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(s)), at]
            live = best != _NEVER
            if not live.all():
                out[rows[~live], : s.shape[1]] = s[~live]
                s, ranks, rows, at, best = s[live], ranks[live], rows[live], at[live], best[live]
            if not len(s):
                return out
            each, width = np.arange(len(s)), s.shape[1]
            move = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            s[each, at] = self.made[best]
            s = np.take_along_axis(s, move, axis=1)
            if width == 2:
                out[rows, :1] = s
                return out
            ranks = np.take_along_axis(ranks, np.minimum(move[:, : width - 2], width - 2), axis=1)
            left, right = at > 0, at < width - 2
            ranks[each[left], at[left] - 1] = self.rank(s[each[left], at[left] - 1], s[each[left], at[left]])
            ranks[each[right], at[right]] = self.rank(s[each[right], at[right]], s[each[right], at[right] + 1])

    def merge_long(self, s: list[int]) -> list[int]:
        """One long fragment: a heap of pairs over a linked list."""
        after, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        heap = [(r, i, s[i], s[i + 1]) for i in range(len(s) - 1) if (r := self.ranks.get(s[i] << 16 | s[i + 1])) is not None]
        heapq.heapify(heap)
        s = list(s)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(s[x] << 16 | s[y])) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x >= 0]

    def encode_pretokens(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty pre-tokens, and each one's length."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.first[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        cut = np.zeros(len(raw), bool)  # before this byte
        cut[1:] = ~self.inside[raw[:-1], raw[1:]]
        cut[ends - sizes] = True
        begin = np.flatnonzero(cut)
        width = np.diff(np.append(begin, len(raw)))
        counts, done, edge = np.empty(len(begin), np.int64), [], 0
        for upper in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, WIDE):
            which = np.flatnonzero((width > edge) & (width <= upper))
            edge = upper
            for part in np.array_split(which, len(which) // 20_000 + 1) if len(which) else ():
                at = begin[part, None] + np.arange(upper)
                held = np.arange(upper) < width[part, None]
                s = np.where(held, symbols[np.minimum(at, len(raw) - 1)], _PAD)
                s = self.merge(s) if upper > 1 else s
                held = s != _PAD
                counts[part] = held.sum(axis=1)
                done.append((part, s[held]))
        for k in np.flatnonzero(width > WIDE).tolist():
            ids = self.merge_long(symbols[begin[k] : begin[k] + width[k]].tolist())
            counts[k] = len(ids)
            done.append((np.array([k]), np.array(ids)))
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for part, ids in done:
            n = counts[part]
            flat[np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, np.add.reduceat(counts, np.searchsorted(begin, ends - sizes))

    def pretokens_of(self, word: str) -> list[bytes | int]:
        """A word's pre-tokens as bytes, added tokens as ids: NFC, lower case letter by letter, split."""
        out: list[bytes | int] = []
        pos = 0
        for m in self.added_pattern.finditer(word) if self.added_pattern else ():
            out += self._split(word[pos : m.start()])
            out.append(self.added[m[0]])
            pos = m.end()
        return out + self._split(word[pos:])

    def _split(self, text: str) -> list[bytes]:
        """Beyond Latin-1 the library itself normalizes and splits: which signs are letters depends on
        its edition of Unicode."""
        if max(text, default="") > "\xff":
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in found]
        return [x.encode() for x in self.pretoken.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))]

    def _split_simple(self, words: list[str]) -> Iterator[list[bytes]]:
        """Pre-tokens of Latin-1 words without added tokens, by one search over all of them."""
        part: list[bytes] = []
        for x in self.pretoken_or_end.findall("\n".join([*words, ""]).lower()):
            if x == "\n":
                yield part
                part = []
            else:
                part.append(x.encode())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words (no ASCII white space inside), and each word's length."""
        simple = [w for w in words if is_simple(w)]
        found = iter(self._split_simple(simple))
        parts = [next(found) if is_simple(w) else self.pretokens_of(w) for w in words]
        flat_parts = [x for p in parts for x in p]
        pre = [x for x in flat_parts if isinstance(x, bytes)]
        lengths = np.ones(len(flat_parts), np.int64)
        ids, sizes = self.encode_pretokens(pre) if pre else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(pre) < len(flat_parts):
            where = np.fromiter((isinstance(x, bytes) for x in flat_parts), bool, len(flat_parts))
            lengths[where] = sizes
            flat = np.empty(int(lengths.sum()), np.uint32)
            mine = np.repeat(where, lengths)
            flat[mine] = ids
            flat[~mine] = [x for x in flat_parts if not isinstance(x, bytes)]
        else:
            flat, lengths = ids, sizes
        per_word = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        last = np.cumsum(per_word)
        return flat, ends[last] - ends[last - per_word]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def encoder(path: str) -> WordCache:
    """One per worker process."""
    return WordCache(vocabulary(path).encode_words)


def _coded(own: WordCache, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Flat ids, offsets of each text in them, and the ids of each as bytes."""
    found = own.encode(texts)
    offsets = np.cumsum([0, *map(len, found)]) // 4
    return np.frombuffer(b"".join(found), "<u4"), offsets, pa.array(found, pa.binary())


def _joined(strings: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The tokens' strings of each row, joined by blanks."""
    tokens = strings.take(pa.array(flat.astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens), " ")


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text: rows (id, n_tokens, ids as little-endian unsigned 32-bit bytes), and
    with ``decoded`` what ``decode`` makes of these ids, in the same pass.

    Null and empty texts have no ids.  Rows stay apart whatever their id (null and repeated ids
    too); other columns are not read; an empty table gives no rows.
    """
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decoded:
        out.add("decoded", T.StringType())
    kind = to_arrow_type(id_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        strings = pa.array(vocabulary(tokenizer).strings)
        for part in slices(batches, text_col):
            flat, offsets, ids = _coded(own, texts_of(part, text_col))
            columns = [part.column(id_col).cast(kind), pa.array(np.diff(offsets)), ids]
            if decoded:
                columns.append(_joined(strings, flat, offsets))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.select(id_col, text_col).mapInArrow(run, out)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` text added: the tokens' strings joined by blanks (the vocabulary has no
    decoder of its own).  Null ids give null; no ids give the empty text."""
    out = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(vocabulary(tokenizer).strings)
        for part in slices(batches, ids_col):
            ids = part.column(ids_col).cast(pa.binary())
            lengths = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(x for x in ids.to_pylist() if x), "<u4")
            joined = _joined(strings, flat, np.concatenate(([0], np.cumsum(lengths // 4))))
            if ids.null_count:
                joined = pc.if_else(ids.is_valid(), joined, None)
            yield pa.RecordBatch.from_arrays([*part.columns, joined], names=out.names)

    return df.mapInArrow(run, out)
