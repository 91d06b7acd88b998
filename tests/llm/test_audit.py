import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import lower, words

from pricetide.llm import decontaminate, filter_audit

SHAPE = "doc_id int, text string, source string, mask int, part string, leads string"


def fails(rows):
    """(part, failures) of every row, by the plain definitions."""
    out = []
    for i, text, source in rows:
        t, w = text or "", words(text)
        f = {c for c, bad in zip("ABCD", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))], strict=True) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            f.add("E")
        out.append((source or "", frozenset(f)))
    return out


def audit(rows, good, toxic):
    failed = fails(rows)
    out, total = {}, Counter()
    for part in {p for p, _ in failed}:
        mine = [(f, i) for (p, f), (i, *_) in zip(failed, rows, strict=True) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                before = len([x for x in mine if c in x[0]]) - len(gone)
                left = [x for x in left if c not in x[0]]
                total[part, c] += len(gone)
                out[part, order, k] = (len(left), len(gone), before, len([x for x in mine if x[0] == {c}]), len([x for x in gone if x[1] in good]), len([x for x in gone if x[1] in toxic]))
    return {(p, o, k): (*v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_lattice_counts_orders():
    for n in (1, 3, 5):
        g = filter_audit.lattice(n)
        through = Counter()
        for order in itertools.permutations(range(n)):
            for k, f in enumerate(order):
                through[sum(1 << x for x in order[:k]), f] += 1
        assert {(s, f): a * b for s, f, a, b in zip(g.state.tolist(), g.added.tolist(), g.arriving.tolist(), g.leaving.tolist(), strict=True)} == through
        assert len(filter_audit.orders(g, "abcde"[:n])) == n * math.factorial(n)


def test_audit_equals_brute_force(spark, odd_texts):
    plain = " ".join(f"word{k}" for k in range(60))
    texts = [*odd_texts, plain, plain + " #", plain.upper(), "same " * 70, "Same & " * 70]
    rows = [(k, t, ["s", None, "", "t"][k % 4]) for k, t in enumerate(texts * 2)]
    rows += [(None, plain, "s"), (None, None, None), (3, texts[3], "t"), (3, plain, "only copies"), (40, plain, "only copies")]
    docs = spark.createDataFrame([(*r, 9, "clash", "clash") for r in rows], SHAPE).repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (5, 1, 0), (5, None, None), (None, 1, 1), (999, 1, 1), (17, 1, 1), (40, 1, 0)], "doc_id long, quality int, toxic int")
    failures = filter_audit.with_marks(filter_audit.text_failures(docs), labels)
    assert failures.count() == len(rows)
    got = filter_audit.steps(filter_audit.edges(failures)).collect()
    want = audit(rows, {0, 5, 17, 40}, {5, 17})
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.removed_good, r.removed_toxic, r.shapley) for r in got} == want
    by_part = defaultdict(int)
    for r in got:
        by_part[r.part, r.filter_order] += r.removed
    failed = Counter(p for p, f in fails(rows) if f)
    assert all(n == failed[p] for (p, _), n in by_part.items())  # every order removes the same documents


def test_audit_edges(spark):
    none = spark.createDataFrame([], SHAPE)
    failures = filter_audit.text_failures(none)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.edges(filter_audit.with_marks(failures, labels)).count() == 0
    own = spark.createDataFrame([("x", True, None, 1), ("x", True, True, 1), (None, False, False, 1)], "shop string, late boolean, dear boolean, _mask int")
    got = {(r.part, r.state, r.filter): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.edges(own, ["late", "dear"], "shop", []).collect()}
    assert got["x", 0, "late"] == (0, 2, 0, 1, 3) and got["x", 1, "dear"] == (0, 0, 1, 0, 1) and got[None, 0, "dear"] == (1, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.edges(own, [f"f{k}" for k in range(8)])


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def passages(docs, items, window=10):
    """Per row: words, hit positions, item ids; every window compared with every run of its size."""
    known = [(i, [w[k : k + min(window, len(w))] for k in range(len(w) - min(window, len(w)) + 1)]) for i, t in items if (w := BENCH_WORD.findall(lower(t)))]
    out = []
    for i, text in docs:
        w, hit, found = BENCH_WORD.findall(lower(text)), set(), set()
        for item, runs in known:
            for run in runs:
                for k in range(len(w) - len(run) + 1):
                    if w[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        found.add(str(item))
        out.append((i, len(w), sorted(hit), sorted(found - {"None"})))
    return out


def scenes(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc") + str(rng.randint(0, 3))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 4, 7, 9, 10, 12, 30])))) for k in range(30)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w) - 1)
            parts += [*w[a : a + rng.randint(1, 25)], *(word() for _ in range(rng.randint(0, 6)))]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs, items


@pytest.mark.parametrize("seed, block", [(1, 1000), (2, 5)])
def test_passages_equal_brute_force(spark, odd_texts, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = scenes(seed)
    docs += [(100 + k, t) for k, t in enumerate(odd_texts)] + [(7, docs[7][1]), (7, "a0 other"), (None, docs[3][1]), (None, None)]
    items += [(40, None), (41, ""), (42, "..."), (5, "a1 A2,b3"), (None, "c3 c2 c1"), (43, items[0][1]), (44, "漢字 ΣΑΣ"), (45, "word " * 30)]
    df = spark.createDataFrame([(*d, "clash", [1]) for d in docs], "doc_id int, text string, item_id string, seeds array<int>").repartition(3)
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, words string")
    key = lambda r: repr(r)
    got = sorted(((r.doc_id, r.n_words, [p for a, b in r.hits for p in range(a, b)], r["items"]) for r in decontaminate.find(df, bench).collect()), key=key)
    assert got == sorted(passages(docs, items), key=key)


def test_passage_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.find(docs, none).collect()) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert decontaminate.find(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    own = decontaminate.find(docs, spark.createDataFrame([("x", "B c"), ("y", "b d")], "k string, q string"), item_col="k", item_text_col="q", window=2, shingle=1).filter("contaminated").collect()
    assert [(r.doc_id, r.n_hit, r["items"], r.hits) for r in own] == [(1, 2, ["x"], [(1, 3)])]
