import functools
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import chat, media, vp_search
from pricetide.llm.q_chat import ORACLE, op2_chat
from pricetide.llm.q_media import op8_media

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, formatted string, window int"


def conversation_rows():
    rng = random.Random(2)
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"), (2, 0, None, None), (2, 5, "assistant", ""), (3, 1, "assistant", r"\<|im_end|>\\<|\n \| <\|"), (3, 0, "us\ner<|", "<|im_start|>assistant\nno"), (None, 0, "assistant", "no id"), (None, 1, "user", "still none"), (5, 0, "assistant", "long " * 4000)]
    for k in range(400):
        rows.append((4, k * 3, "system" if k == 0 else rng.choice(["user", "assistant", "system"]), "w" * (60 if k == 0 else rng.randint(0, 2400 if k % 9 == 0 else 900))))
    return [(*r, "clash", 7) for r in rows]


def test_windows_give_back_every_turn_once(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    windows = chat.read_turns(chat.format_windows(df, budget=400, history=100)).collect()
    for conv in {r[0] for r in rows}:
        own = sorted((w for w in windows if w.conv_id == conv), key=lambda w: w.window)
        key = lambda r: (r[1], r[2] or "", r[3] or "")
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [tuple(t) for w in own for t in w.turns] == want
        assert [t for w in own for t in w.targets] == [t for role, t in want if role == "assistant"]
        size = lambda t: -(-len(t) // 4) + 4
        for w in own:
            sizes = [size(t.text) for t in w.turns]
            context = chat.START + chat.START.join(w.formatted.split(chat.START)[1 : w.n_context + 1]) if w.n_context else ""
            parts = [p.split("\n", 1)[1].removesuffix(chat.END + "\n") for p in context.split(chat.START)[1:]]
            assert w.n_tokens == sum(sizes) + sum(map(size, parts)) and len(parts) == w.n_context
            system = size(parts[0]) if conv == 4 and w is not own[0] else 0
            assert w.n_tokens <= 400 or (len(sizes) == 1 and sizes[0] + system > 400 and w.n_context == bool(system))
            assert sum(map(size, parts)) - system <= 100
            if conv == 4:
                assert w.formatted.startswith("<|im_start|>system\n")
                assert w.n_context > 0 or w is own[0]
                spans = {w.formatted[s.start : s.start + s.length] for s in w.loss}
                assert spans <= {t.text for t in w.turns if t.role == "assistant"}
    assert chat.format_windows(df.limit(0)).count() == 0


def test_every_window_of_the_query_keeps_its_budget(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = chat.format_windows(df).collect()
    assert max(r.n_tokens for r in rows if r.n_own > 1) <= chat.BUDGET
    assert sum(r.n_tokens > chat.BUDGET for r in rows) == 0 and sum(r.n_context > 1 for r in rows) > 0


@pytest.mark.parametrize("system", [0, 1400, 2400, 3600, 4400, 9000])
def test_system_turns_of_any_length_stay(spark, system):
    """However long, it is in every window; history gives way to it, and only with no room left the budget does."""
    rng = random.Random(system)
    rows = [(7, 0, "system", "s" * system)] + [(7, k, "user" if k % 2 else "assistant", f"{k} " + "w" * rng.randint(0, 600)) for k in range(1, 120)]
    windows = sorted(chat.read_turns(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect(), key=lambda w: w.window)
    assert [tuple(t) for w in windows for t in w.turns] == [r[2:] for r in rows] and len(windows) > 5
    size = -(-system // 4) + 4
    for w in windows[1:]:
        assert w.formatted.startswith(f"<|im_start|>system\n{'s' * system}<|im_end|>\n<|im_start|>")
        assert w.n_tokens <= max(chat.BUDGET, size + chat.LEAST)
    assert any(w.n_context > 1 for w in windows) == (size + chat.LEAST < chat.BUDGET)


def test_chat_query_is_native_and_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    df = op2_chat(spark, FOLDER)
    want = con.sql(ORACLE)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute(vectors, k, query):
    good = {i: np.array(v, float) for i, v in vectors.items() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if query(q):
            s = sorted((-float(good[q] @ v / (np.linalg.norm(good[q]) * np.linalg.norm(v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, round(-x, 9)) for x, i in s[:k]]
    return out


def vectors_of(n=600, dim=8):
    rng = np.random.default_rng(1)
    out = {k: rng.normal(size=dim).round(3).tolist() for k in range(n)}
    out |= {1000 + k: out[3] for k in range(40)} | {1100: [0.0] * dim, 1110: None, 1120: [None] + [1.0] * (dim - 1), 1130: [math.nan] * dim, 1140: [math.inf] + [0.0] * (dim - 1), 1150: [1.0, 2.0], 1151: [2.0, 1.0], 1160: []}
    return out


SHAPE = "vec_id long, embedding array<double>, score int"


def test_exact_search(spark):
    vectors = vectors_of()
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors.items()] + [(None, [1.0] * 8, 0)], SHAPE).repartition(3)
    got = {}
    for r in vp_search.nearest(df, lambda i: i % 10 == 0, shard_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = brute(vectors, 5, lambda i: i % 10 == 0)
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()} == want
    assert vp_search.nearest(df.limit(0), lambda i: i % 10 == 0).count() == 0
    few = vp_search.nearest(df.filter("vec_id in (10, 11)"), lambda i: i % 10 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(10, 1, 11)]


def test_relaxed_search_recalls_enough():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 32))
    points = (centers[rng.integers(0, 30, 4000)] + 0.3 * rng.normal(size=(4000, 32)))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids, q = np.arange(4000), points[:200]
    tree = vp_search.VPTree(points)
    exact, relaxed = (tree.search(q, 5, f, ids[:200], ids)[1] for f in (1.0, 1.5))
    hits = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, relaxed, strict=True)])
    true = np.argsort(-(q @ points.T) + 9 * (ids[None, :] == ids[:200, None]), axis=1)[:, :5]
    assert all(set(a) == set(b) for a, b in zip(exact, true, strict=True))
    assert hits >= 0.9


def test_frames_round_trip():
    rng = np.random.default_rng(3)
    for s in (rng.integers(0, 256, (40, 576)), np.full((3, 576), 255), np.zeros((2, 576)), np.tile([0, 255], (2, 288))):
        s = s.astype(np.uint8)
        data, ends = media.encode_frames(s)
        data, ends = data.tobytes(), [0, *ends.tolist()]
        frames = [media._HEAD + data[a:b] + media._EOI for a, b in zip(ends, ends[1:], strict=False)]
        file = media.avi(frames)
        assert struct.unpack_from("<I", file, 4)[0] == len(file) - 8
        assert media.read_avi(file) == frames
        assert (media.decode_frames([media.scan_of(f) for f in frames]) == s).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")


def test_shots():
    frames = np.concatenate([np.full((10, 576), 20), np.full((8, 576), 200), np.full((5, 576), 90)]).astype(np.uint8)
    assert media.shots_of(frames) == [(0, 10), (10, 18), (18, 23)]
    assert media.shots_of(frames[:1]) == [(0, 1)]


def test_media_columns(spark, odd_texts):
    df = spark.createDataFrame([(k, t, b"x") for k, t in enumerate(odd_texts)] + [(None, "x", b"y")], "doc_id long, text string, payload binary").repartition(2)
    got = media.load(media.store(df)).collect()
    assert len(got) == len(odd_texts) + 1
    for r in got:
        text = ((odd_texts[r.doc_id] if r.doc_id is not None else "x") or "").encode()
        assert r.n_bytes == len(text) and bytes(r.payload) == text.ljust(max(1, -(-len(text) // 576)) * 576, b"\xff")
        assert sum(c.n_frames for c in r.clips) * 576 == len(r.payload) and r.clips[0].start_ms == 0
    assert media.load(media.store(df.limit(0))).count() == 0
    none = media.load(df.select("doc_id", F.lit(None).cast("binary").alias("media"))).first()
    assert none.payload is None and none.clips is None


def test_media_query_digests(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    stored = {r.doc_id: bytes(r.media) for r in media.store(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    rows = op8_media(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    features = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        file = stored[r.doc_id]
        assert media.decode_frames([media.scan_of(f) for f in media.read_avi(file)]).tobytes() == payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
        assert features.setdefault(raw, r.feature) == r.feature


def test_scaled_copies_of_one_direction(spark):
    """Many copies of a direction differ in rounding only: the exact score decides, then the smaller id."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=24)
    rows = [(k, [float(x) for x in base * scale]) for k, scale in enumerate(rng.permutation(np.linspace(0.1, 9, 400)))]
    got = {}
    for r in vp_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 40 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    total = lambda x, y: functools.reduce(lambda s, ab: s + ab[0] * ab[1], zip(x, y, strict=True), 0.0)
    for q in range(0, 400, 40):
        score = lambda v: total(rows[q][1], v) / (math.sqrt(total(rows[q][1], rows[q][1])) * math.sqrt(total(v, v)))  # noqa: B023, E731
        want = sorted((-score(v), k) for k, v in rows if k != q)[:5]
        assert sorted(got[q]) == [(i + 1, k) for i, (_, k) in enumerate(want)]
