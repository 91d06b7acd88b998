"""Token ids by the tokenizers library, encoded word by word through a bounded cache.

With this kind of vocabulary white space separates words and is dropped, so a text's ids are
its words' ids in a row.  Most words of a corpus come again: a worker asks the library once for
each word that it does not hold.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

#: Words of a generation that a worker keeps (and those of one slice of texts more).
CACHE_WORDS = 300_000
#: str.split() also cuts at these, which are no white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\x20\x09-\x0d]+")
#: Letters, then signs that are neither apostrophes nor "<": one or two parts to the tokenizer.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@[-`{-~]*)")
_SIMPLE = re.compile("[!-;=-~¡-¬®-ÿ]+")


def is_simple(word: str) -> bool:
    """Visible Latin-1 without "<": normalization only changes its case, and no added token is in it."""
    return bool(_SIMPLE.fullmatch(word))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class WordCache:
    """Ids of words met before, as little-endian unsigned 32-bit bytes; a text's are its words' in a row.

    ``encode_words`` gives flat ids and lengths for words that are not held.  There are two generations:
    once the young one is full it becomes the old one, and words that come again move on."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        self.encode_words, self.limit = encode_words, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        again = {w: ids for w in words if (ids := self.old.get(w)) is not None}
        self.young |= again
        if missing := list(words.difference(again)):
            flat, lengths = self.encode_words(missing)
            raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            self.young.update(zip(missing, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  Words and ids make no cycles, so the collector, which would walk through
        lists of them again and again, waits meanwhile."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        collects = gc.isenabled()
        gc.disable()
        try:
            words = [words_of(t) for t in texts]
            if unknown := set().union(*words).difference(self.young):
                self._learn(unknown)
            ids = self.young.__getitem__
            return [b"".join(map(ids, w)) for w in words]
        finally:
            if collects:
                gc.enable()


@cache
def library_encoder(path: str) -> WordCache:
    """One per worker process: words encoded by the tokenizers library, truncation and padding off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    suffix = json.loads(tok.to_str())["model"].get("end_of_word_suffix")
    strings = tok.get_vocab(with_added_tokens=False)
    closing = np.zeros(tok.get_vocab_size() + 1, bool)
    closing[[i for s, i in strings.items() if suffix and s.endswith(suffix)]] = True

    def ids_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words go to the library many at a time: each of their one or two parts ends in a closing
        token.  Should the number of these not be right, all words go one by one."""
        plain = list(map(_PLAIN.fullmatch, words)) if suffix else [None] * len(words)
        joined = [k for k, m in enumerate(plain) if m]
        flat, _ = ids_of([" ".join(words[k] for k in joined[x : x + 200]) for x in range(0, len(joined), 200)])
        at, last = np.flatnonzero(closing[flat]) + 1, np.cumsum([1 + bool(plain[k][2]) for k in joined], dtype=np.int64)
        if not joined or len(at) != last[-1]:
            return ids_of(words)
        other = [k for k, m in enumerate(plain) if not m]
        flat_other, lengths_other = ids_of([words[k] for k in other])
        lengths = np.zeros(len(words), np.int64)
        lengths[joined], lengths[other] = np.diff(at[last - 1], prepend=0), lengths_other
        mine = np.zeros(len(words), bool)
        mine[joined] = True
        mine = np.repeat(mine, lengths)
        out = np.empty(len(mine), np.uint32)
        out[mine], out[~mine] = flat, flat_other
        return out, lengths

    return WordCache(encode_words)
