import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricetide.llm import align, q_align
from pricetide.llm.q_align import BYTES, PIECES

SHAPE = "doc_id int, text string, block string, id int"


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@functools.cache
def byte_of(char):
    """The byte-level alphabet, found by asking for the visible characters first."""
    visible = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    return ord(char) if ord(char) in visible else [b for b in range(256) if b not in visible][ord(char) - 256]


def tokens(libraries, text):
    """((id, begin, end) of a, of b) by bytes of blank and text, from the libraries' whole texts."""
    tok, sp = libraries
    whole = (" " + (text or "")).encode()
    out = []
    for ids, spell in ((tok.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(byte_of(c) for c in tok.id_to_token(i))), (sp.encode(text or ""), lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := sp.id_to_piece(i)) else p.replace("▁", " ").encode())):
        at, rows = 0, []
        for i in ids:
            rows.append((i, at, at := at + len(spell(i))))
        if not text or b"".join(map(spell, ids)) != whole:
            return [], []
        out.append(rows)
    return tuple(out)


def brute(libraries, rows):
    docs = [(i, *tokens(libraries, t)) for i, t in rows]
    found = [[(x[0], y[0]) for y in b for x in by_end.get(y[2], ())] for _, a, b in docs for by_end in [{x[2]: [x] for x in a}]]
    counts = Counter(p for links in found for p in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, a, b), links in zip(docs, found, strict=True):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        parts = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for x in side:
                parts[bisect_left(cuts, x[2])][k].append(str(x[0]))
        groups = [tuple(map(",".join, p)) for p in parts]
        digest = hashlib.sha256(";".join(map("|".join, groups)).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    odd = ["<|endoftext|> and <s></s><unk>", "▁ low ▁▁ line", "tabs\t\tand\n\n  lines \r\n x", "  lead  and  trail  ", " ", "end 　 ", "a᠎ b\x1c c\x85 d", "zero\x00byte", "é é \U0001f468‍\U0001f469‍\U0001f467 हिन्दी 漢字漢字", "don't we'll I'M x's", "1234567 12.5% a1b2", "=" * 300 + " " * 90 + "x"]
    parts = [*odd, "the", "word", "中文", "\n", "  ", "▁", ".", "it's"]
    return odd + ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 12))) for _ in range(60)]


@pytest.mark.parametrize("limit", [align.CACHE_UNITS, 3])
def test_alignment_equals_whole_texts(spark, odd_texts, libraries, monkeypatch, limit):
    monkeypatch.setattr(align, "BLOCK_BYTES", 2000)
    rows = list(enumerate([*odd_texts, *texts()])) + [(None, "no id"), (3, "the word twice"), (3, "the word twice")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SHAPE).repartition(2)
    got = sorted((tuple(r) for r in align.align(df, BYTES, PIECES).collect()), key=repr)
    assert got == brute(libraries, rows)
    own = align.Aligner(BYTES, PIECES, limit)
    for _, t in rows:
        (found,) = own.documents([t or ""])
        a, b = tokens(libraries, t)
        assert (found is None) == (not a) and (found is None or found[2:4] == (len(a), len(b)))


def test_links(spark, odd_texts, libraries):
    rows = list(enumerate([*odd_texts[:6], *odd_texts[7:], *texts()[:20]]))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {k: sorted(tuple(r) for r in align.links(df, BYTES, PIECES, k).collect()) for k in align.KINDS}
    want = {k: [] for k in align.KINDS}
    for d, t in rows:
        a, b = tokens(libraries, t)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        group = lambda e, cuts=cuts: bisect_left(cuts, e)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                shared = min(x[2], y[2]) - max(x[1], y[1])
                row = (d, i, j, x[0], y[0])
                if shared > 0:
                    want["overlap"].append((*row, shared))
                if x[2] == y[2]:
                    want["end"].append((*row, shared))
                if group(x[2]) == group(y[2]):
                    want["group"].append((*row, 1))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_products_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    for room in (1, 7, 1 << 20):
        monkeypatch.setattr(align, "PRODUCT_ENTRIES", room)
        dense = [rng.random((6, 9)) < 0.3, rng.random((5, 9)) < 0.4]
        a, b = (align.Csr(np.concatenate(([0], np.cumsum(m.sum(axis=1)))), np.nonzero(m)[1], 9) for m in dense)
        out = np.zeros((6, 5), int)
        for i, j, n in align.product(a, b.transposed()):
            out[i, j] += n
        assert (out == dense[0].astype(int) @ dense[1].T.astype(int)).all()


def test_alignment_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none, BYTES, PIECES).count() == 0 and align.links(none, BYTES, PIECES).count() == 0
    repeated = spark.createDataFrame([("x", "the " * 3000), ("x", None)], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_a, r.n_links > 0, r.count_sum) for r in align.align(repeated, BYTES, PIECES).collect())[0] == ("x", 0, False, 0)


def test_query_equals_whole_texts(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in q_align.op13_align(spark, folder).collect()), key=repr) == brute(libraries, rows)
