import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions.trigram import trigrams
from pricetide.operators import matching

LISTINGS = "listing int, raw_name string, category_slug string, cls_set_code string, cls_language string, cls_packaging string"
PRODUCTS = "product_id int, name_canonical string, category_slug string, set_code string, language string, packaging string"


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}


def brute(listings, products, k):
    out = {}
    for n, name, category, code, language, packaging in listings:
        rows = []
        for p, canonical, c, s, lang, pack in products:
            if category is None or c != category:
                continue
            a, b = grams(name), grams(canonical)
            score = len(a & b) / len(a | b) if a | b else 0.0
            hits = [x is not None and x == y for x, y in ((code, s), (language, lang), (packaging, pack))]
            rows.append(([not h for h in hits], -score, p))
        for rank, (_, score, p) in enumerate(sorted(rows)[:k], 1):
            out[n, rank] = (p, round(-score, 9))
    return out


def catalog_and_listings(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    name = lambda: rng.choice([None, "", "?!", *(" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(9))])
    some = lambda *x: rng.choice(x)
    names = [name() for _ in range(60)]
    products = [(k, some(*names, "box of " + word()), some("A", "A", "B"), some("OP1", "OP2", None), some("EN", "JP", None), some("display", None)) for k in range(150)]
    listings = [(k, some(*names, name()), some("A", "B", None, "C"), some("OP1", "OP2", "ZZ9", None), some("EN", "JP", "KR", None), some("display", "case", None)) for k in range(80)]
    return products, listings


@pytest.mark.parametrize("large", [0, 8, 10**9])
def test_candidates_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(matching, "LARGE", large)
    monkeypatch.setattr(matching, "FIRST_POSTINGS", 3)
    products, listings = catalog_and_listings(large)
    got = matching.candidates(spark.createDataFrame(listings, LISTINGS).repartition(3), spark.createDataFrame(products, PRODUCTS), ["listing"], 3, ["NONE"]).collect()
    assert {(r.listing, r["rank"]): (r.product_id, round(r.score, 9)) for r in got} == brute(listings, products, 3)
    assert all((r.raw_name, r.category_slug) == next(x[1:3] for x in listings if x[0] == r.listing) for r in got)


def test_listings_meet_few_names_of_a_large_cell(spark):
    """Every product of the cell shares its common words with every listing; rare words decide."""
    rng = random.Random(1)
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1500)]
    offers = spark.createDataFrame([(k, f"booster box {w} english", "A") for k, w in enumerate(rare)], "product_id int, name_canonical string, cell string")
    offers = offers.select("product_id", "name_canonical", F.struct("cell").alias("_offered"), F.struct("name_canonical").alias("_name"), trigrams(F.col("name_canonical")).alias("_p"))
    asks = spark.createDataFrame([(k, f"Booster Box {rare[7 * k]} (English)") for k in range(50)] + [(99, "???")], "_ask int, name string")
    opened = asks.select("_ask", trigrams(F.col("name")).alias("_g"), F.struct(F.lit("A").alias("cell")).alias("_offered"))
    found = matching._likely(opened, offers, 1)
    assert found.count() < 50 * 40  # of 51 * 1500
    hits = {r._ask: r.names for r in found.groupBy("_ask").agg(F.collect_set("_name.name_canonical").alias("names")).collect()}
    assert all(f"booster box {rare[7 * k]} english" in hits[k] for k in range(50)) and hits[99] == [f"booster box {rare[0]} english"]


def test_listings_alike_ask_once(spark, monkeypatch):
    asked = {}

    def counted(df, name):
        asked[name] = df.count()
        return df

    monkeypatch.setattr(matching, "written", counted)
    products, listings = catalog_and_listings(3)
    many = [(100 * copy + n, *rest) for copy in range(20) for n, *rest in listings]
    got = matching.candidates(spark.createDataFrame(many, LISTINGS), spark.createDataFrame(products, PRODUCTS), ["listing"], 3, ["NONE"]).collect()
    assert {(r.listing, r["rank"]): (r.product_id, round(r.score, 9)) for r in got} == brute(many, products, 3)
    assert asked["asks"] == len({tuple(rest) for _, *rest in listings}) and asked["answers"] <= 3 * asked["asks"]
