import random

import pytest
from conftest_llm import lower, words

from pricetide.llm import components, minhash, substring_dedup
from pricetide.llm.q_dedup import op6_minhash


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_repeats(docs, window):
    first = {}
    for k in sorted(docs):
        w = words(docs[k])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k, text in docs.items():
        w = words(text)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out[k] = (len(w), len(gone), None if text is None else " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def passages(seed):
    """Documents of a small vocabulary with copies, cut passages, repeated lines."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(30, 200))) for _ in range(6)]
    docs = {}
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = words(rng.choice(base))
            a = rng.randint(0, len(w) - 1)
            parts += w[a : a + rng.randint(1, 120)]
        if rng.random() < 0.5:
            parts[rng.randrange(len(parts))] = "edit"
        docs[k] = " ".join(parts)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, odd_texts, seed):
    docs = passages(seed) | {100 + k: t for k, t in enumerate(odd_texts)} | {200: "lo lo " * 200, 201: "lo lo " * 100}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(docs, 50)


def test_a_passage_in_other_surroundings_everywhere(spark, monkeypatch):
    """Every occurrence is a class of its own and one window is in every row: no task takes them all."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 20)
    shared = " ".join(f"w{k}" for k in range(55))
    docs = {k: f"a{k} b{k} {shared} c{k} " + " ".join(f"t{k}.{i}" for i in range(20)) for k in range(60)}
    rows = [(k, t) for k, t in docs.items()] + [(7, docs[7])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(docs, 50)


def test_substring_edges(spark):
    text = " ".join(f"w{k}" for k in range(60))
    shape = "doc_id long, text string"
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (5, text + " more"), (9, "  " + text.replace(" ", "\n"))], shape)
    out = substring_dedup.remove_repeats(rows, collapse=False)
    got = sorted((r.doc_id or -1, r.n_removed) for r in out.collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (5, 0), (9, 60)]
    assert substring_dedup.remove_repeats(rows.limit(0)).count() == 0
    one = substring_dedup.remove_repeats(spark.createDataFrame([(1, "a\n b")], shape), collapse=False).first()
    assert one.text == "a\n b"


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_copies(seed, size=60):
    rng = random.Random(seed)
    docs, k = {}, 0
    for _ in range(4):
        base = [f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}" if rng.random() < 0.7 else "the"
            docs[k] = " ".join(w)
            k += 1
    return docs


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 85, 1000), (2, 80, 20), (3, 85, 7)])
def test_near_duplicates_equal_brute_force(spark, odd_texts, seed, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_copies(seed) | {1000 + k: t for k, t in enumerate(odd_texts)} | {2000: "SAME Text here again and AGAIN"}
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, component_id int").repartition(3)
    sets = {k: shingles(t) for k, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(docs, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in docs}


def test_near_duplicate_edges(spark):
    shape = "doc_id long, text string"
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, None), (8, "")], shape)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(-1, None, True), (4, 4, True), (4, 4, True), (7, 7, True), (8, 8, True)]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(0, k) for k in range(200, 260)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = union_find({n for p in real for n in p}, real)
    assert {r.node: r.component for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    assert {r.doc_id: r.component_id for r in op6_minhash(spark, folder).collect()} == want


def test_hot_anchors_and_classes_take_the_broadcast_path(spark, monkeypatch):
    """A passage that all documents share, alone and in varying surroundings."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 5)
    line = " ".join(f"p{k}" for k in range(70))
    rng = random.Random(9)
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**9)}" for _ in range(n))
    docs = {k: line if k % 3 == 0 else f"{noise(40)} {line} {noise(30)}" for k in range(60)} | passages(3)
    docs = {k: t + " " + line for k, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(docs, 50)


def test_clashing_names_and_text_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([("1", text, 7, 8, "x"), ("2", text, 7, 8, "y"), ("two", text, 7, 8, "z")], "doc_id string, text string, _id int, _tag int, _spans string")
    got = {r.doc_id: (r.n_removed, r._id, r._tag, r._spans) for r in substring_dedup.remove_repeats(rows).collect()}
    assert got == {"1": (0, 7, 8, "x"), "2": (60, 7, 8, "y"), "two": (0, 7, 8, "z")}
    near = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert near == [(-1, None, True), (1, 1, True), (2, 1, False)]


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_keep_every_pair_at_the_threshold(spark, percent):
    """Pairs of exactly the threshold among templates: each meets in the prefixes, none below need do so."""
    docs, k = {}, 0
    for size in (17, 40, 100):
        for edits in range(0, size // 3):
            body = [f"s{size}x{i}" for i in range(size)]
            docs[k] = frozenset(body)
            docs[k + 1] = frozenset(body[edits:] + [f"s{size}e{edits}y{i}" for i in range(edits)])
            k += 2
    number = {x: i for i, x in enumerate(sorted({x for s in docs.values() for x in s}))}
    import numpy as np

    rows = [(k, len(s), np.sort(np.array([number[x] for x in s], np.uint64)).tobytes()) for k, s in docs.items()]
    sets = spark.createDataFrame(rows, "rep long, n long, shingles binary").repartition(2)
    placed = minhash._prefixes(sets, percent).withColumn("comp", minhash.F.col("rep"))
    got = {(r.a, r.b) for r in minhash._across(placed, percent).collect()}
    want = {(a, b) for a in docs for b in docs if a < b and 100 * len(docs[a] & docs[b]) >= percent * len(docs[a] | docs[b])}
    assert want <= got
