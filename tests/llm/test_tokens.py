import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm import bpe, packing, q_tokens, token_file, tokens

SHAPE = "doc_id long, text string, ids string, start int"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(q_tokens.TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(odd_texts)] + [(None, "no id", "clash", 1), (3, "one", "clash", 1)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))}
        fill = packing.best_fill(dict(counts), room)
        assert all(n <= counts[k] for k, n in fill.items())
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= room)


def test_packing(spark, tok, docs):
    rows = packing.pack(docs, q_tokens.TOKENIZER, pool_tokens=3000).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for doc in docs.filter("doc_id <> 3 or doc_id is null").collect():
        want = packed([*ids_of(tok, doc.text), 1])
        assert b"".join(p for _, p, _ in sorted(pieces[doc.doc_id])) == want
        assert {n for _, _, n in pieces[doc.doc_id]} == {len(want) // 4}
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * (len(ids_of(tok, "one")) + 1)
    assert packing.pack(docs.limit(0), q_tokens.TOKENIZER).count() == 0


def test_bpe_equals_library(spark, tok, docs):
    both = bpe.encode(docs, q_tokens.TOKENIZER, decoded=True).collect()
    again = {(r.doc_id, r.n_tokens): r.decoded for r in bpe.decode(bpe.encode(docs, q_tokens.TOKENIZER), q_tokens.TOKENIZER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(both) == docs.count()
    for r in both:
        ids = ids_of(tok, texts[r.doc_id])
        assert bytes(r.ids) == packed(ids) and r.n_tokens == len(ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) == again[r.doc_id, r.n_tokens]


def test_bpe_on_random_words(tok):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghtheing'!. ́é漢1AΣ\x1f\xa0<|>ñ") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["ab" * 400 + " " + "the" * 300]
    for cache in (bpe.encoder(q_tokens.TOKENIZER), tokens.library_encoder(q_tokens.TOKENIZER), tokens.WordCache(bpe.vocabulary(q_tokens.TOKENIZER).encode_words, limit=50)):
        for some in (texts[:700], texts[300:], texts):
            assert cache.encode(some) == [packed(ids_of(tok, text)) for text in some]


def test_files_are_bounded(spark, tok, docs, monkeypatch):
    """Small batches, so that files end within a range of ids; documents stay in order all the same."""
    monkeypatch.setattr(token_file, "FILE_TOKENS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        index = token_file.write(docs.coalesce(1), q_tokens.TOKENIZER, length=4)
        assert index.select("file").distinct().count() > 4
        rows = sorted(token_file.read(index).collect(), key=lambda r: r.start)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    texts = {r.doc_id: r.text for r in docs.filter("doc_id <> 3").collect()}
    assert {r.doc_id: bytes(r.ids) for r in rows if r.doc_id in texts} == {k: packed([*ids_of(tok, t), 2]) for k, t in texts.items()}


def test_token_file(spark, tok, docs):
    docs = docs.filter("doc_id is null or doc_id <> 3").unionByName(spark.createDataFrame([(3, "one", "", 1)], SHAPE))
    index = token_file.write(docs, q_tokens.TOKENIZER, length=64)
    rows = sorted(token_file.read(index).collect(), key=lambda r: r.start)
    texts, at = {r.doc_id: r.text for r in docs.collect()}, 0
    assert [r.doc_id for r in rows] == sorted(texts, key=lambda k: -1 if k is None else k)
    for r in rows:
        ids = [*ids_of(tok, texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), packed(ids))
        at += len(ids)
    for (name,) in index.select("file").distinct().collect():
        found = token_file.Reader(name)
        n = sum(len(found.batch(k)) for k in range(found.n_batches))
        masks = np.concatenate([found.sequence(k)[1] for k in range(n)])
        assert masks.sum() == index.filter(F.col("file") == name).agg(F.sum("n_tokens")).first()[0]
        assert (found.sequence(0)[0] == found.read(0, 64)).all()
    assert token_file.read(token_file.write(docs.limit(0), q_tokens.TOKENIZER)).count() == 0


def test_queries(spark, tok):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    ids = {k: ids_of(tok, v) for k, v in texts.items()}
    at = 0
    for r in sorted(q_tokens.op5_token_file(spark, folder).collect()):
        want = packed([*ids[r.doc_id], 2])
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(want))
        at += r.n_tokens
    for r in q_tokens.op3_bpe(spark, folder).collect():
        assert r.ids_sha256 == hashlib.sha256(packed(ids[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    for r in q_tokens.op1_packing(spark, folder).collect():
        assert r.ids_crc32 == zlib.crc32(packed([*ids[r.doc_id], 1][r.start : r.start + r.length]))
