"""Matching of listings to catalog products: candidates, evidence, decision, gaps.

Candidates are ranked by three flags before similarity, and flags depend on four attributes only.  So
groups of equal attributes meet cells of equal attributes first, cells that cannot reach the k-th
place go, and names are compared only where flags leave the order open.  Listings of one name and
attributes ask once, so the work follows the different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.columns import first_case, is_true
from pricetide.functions.trigram import similarity, trigrams
from pricetide.sources.storage import written

REVIEW, CONFIRMED = 0.35, 0.6
LANGUAGES = ["EN", "JP", "ES"]


def single_product_categories(products: DataFrame, category: str = "category_slug") -> DataFrame:
    return products.groupBy(category).agg(F.count("*").alias("n")).filter("n = 1").select(category)


_ASKED = ["category_slug", "cls_set_code", "cls_language", "cls_packaging"]
_OFFERED = ["p_category", "p_set_code", "p_language", "p_packaging"]


def _flags() -> dict[str, Column]:
    language = F.when(F.col("cls_language").isin(LANGUAGES), F.col("cls_language"))
    return {
        "code_hit": is_true(F.col("p_set_code") == F.col("cls_set_code")),
        "language_hit": is_true(F.col("p_language") == language),
        "packaging_hit": is_true(F.col("p_packaging") == F.col("cls_packaging")),
    }


#: Names of a cell from which a listing meets only those that can be among its best, and postings it looks at first.
LARGE, FIRST_POSTINGS = 1000, 64


def _best(asks: DataFrame, catalog: DataFrame, asked: str, offered: str, k: int) -> DataFrame:
    """Each ask's k best products with ``offered`` equal to ``asked``: by flags, similarity, id.

    Nulls are values of the other attributes, so they travel as a struct that equals itself.  A name is compared once
    with the k smallest ids of its flags, however many products of however many cells bear it."""
    flags = _flags()
    groups = asks.select(*_ASKED, "_asked").distinct()
    cells = catalog.groupBy(*_OFFERED).agg(F.count("*").alias("_n"), F.count_distinct(F.struct("name_canonical")).alias("_names")).withColumn("_offered", F.struct(*_OFFERED))
    met = groups.join(cells, F.col(asked) == F.col(offered)).withColumns(flags)
    better = Window.partitionBy("_asked").orderBy(*(F.desc(c) for c in flags)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("_asked", *flags)
    open_cells = met.withColumn("_before", F.sum("_n").over(better) - F.sum("_n").over(level)).filter(F.col("_before") < k).select("_asked", "_offered", "_names", *flags)
    # of a name that comes often in a cell only the k smallest ids can be among the best
    same = Window.partitionBy(*_OFFERED, "name_canonical").orderBy("product_id")
    few = catalog.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k)
    offers = few.groupBy(F.struct(*_OFFERED).alias("_offered"), F.struct("name_canonical").alias("_name")).agg(F.sort_array(F.collect_list(F.struct("product_id", *_OFFERED))).alias("_ids"))
    grams = trigrams(F.col("_name.name_canonical")).alias("_p")
    meant = open_cells.filter(F.col("_names") <= LARGE).join(offers, "_offered").repartition("_asked")
    meant = meant.groupBy("_asked", *flags, "_name").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_ids"))), 1, k).alias("_ids"))
    shape = ["_asked", "_ask", *flags, "_name", "_ids", similarity(F.col("_g"), F.col("_p")).alias("score")]
    scored = asks.select("_asked", "_ask", "_g").join(meant.select("*", grams), "_asked").select(*shape)
    if (cells.agg(F.max("_names")).first()[0] or 0) > LARGE:
        large = asks.select("_asked", "_ask", "_g").join(open_cells.filter(F.col("_names") > LARGE), "_asked")
        sized = offers.select("*", grams, F.get("_ids", 0)["product_id"].alias("product_id"))
        likely = _likely(large, sized, k)
        scored = scored.unionByName(large.join(likely, ["_ask", "_offered"]).join(sized, ["_offered", "_name"]).select(*shape))
    own = Window.partitionBy("_asked", "_ask")
    first = own.orderBy(*(F.desc(c) for c in flags), F.desc("score"), F.get("_ids", 0)["product_id"])
    named = scored.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    rows = named.select("_asked", "_ask", *flags, "score", F.col("_name.name_canonical").alias("name_canonical"), F.explode("_ids").alias("_o")).select("_asked", "_ask", "_o.*", "name_canonical", *flags, "score")
    order = own.orderBy(*(F.desc(c) for c in flags), F.desc("score"), "product_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _likely(opened: DataFrame, offers: DataFrame, k: int) -> DataFrame:
    """(_ask, _offered, _name): the names of a cell that can be among an ask's k best ones in it.

    Trigrams are ordered by rarity in the cell.  The names that a few of the rarest lead to give a bound on the
    k-th best score.  A name as good as that shares a trigram so early in both orders that enough is
    left behind it on both sides; names are looked up by such trigrams alone.  Names that share nothing score
    zero, so of these the products of smallest id come along."""
    names = offers.join(opened.select("_offered").distinct(), "_offered", "left_semi").groupBy("_offered", "_name").agg(F.first("_p").alias("_p"), F.min("product_id").alias("_id"))
    grams = names.select("_offered", "_name", F.size("_p").alias("_m"), F.explode("_p").alias("_t"))
    often = grams.groupBy("_offered", "_t").agg(F.count("*").alias("_d"))
    place = lambda *own: F.row_number().over(Window.partitionBy(*own).orderBy("_d", "_t")) - 1
    postings = grams.join(often, ["_offered", "_t"]).withColumn("_j", place("_offered", "_name")).drop("_d")
    own = opened.select("_ask", "_offered", F.size("_g").alias("_s"), F.explode("_g").alias("_t")).join(often, ["_offered", "_t"], "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    before = Window.partitionBy("_ask", "_offered").orderBy("_d", "_t").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_i", place("_ask", "_offered")).withColumn("_seen", F.coalesce(F.sum("_d").over(before), F.lit(0))).filter("_d > 0")
    pair = ["_ask", "_offered", "_name"]
    first = own.filter(F.col("_seen") < FIRST_POSTINGS).join(postings, ["_offered", "_t"]).select(*pair).distinct()
    first = first.join(opened.select("_ask", "_offered", "_g"), ["_ask", "_offered"]).join(names.select("_offered", "_name", "_p"), ["_offered", "_name"])
    ranked = first.withColumn("_score", similarity(F.col("_g"), F.col("_p"))).withColumn("_r", F.row_number().over(Window.partitionBy("_ask", "_offered").orderBy(F.desc("_score"))))
    bounds = ranked.filter(F.col("_r") == k).select("_ask", "_offered", F.col("_score").alias("_least"))
    bounded = own.join(bounds, ["_ask", "_offered"], "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)))
    enough = F.least(F.col("_s") - F.col("_i"), F.col("_m") - F.col("_j")) * (1 + F.col("_least")) >= F.col("_least") * (F.col("_s") + F.col("_m")) - 1e-9
    early = (F.col("_s") - F.col("_i")) >= F.col("_least") * F.col("_s") - 1e-9
    found = bounded.filter(early).join(postings, ["_offered", "_t"]).filter(enough).select(*pair)
    low = names.withColumn("_r", F.row_number().over(Window.partitionBy("_offered").orderBy("_id"))).filter(F.col("_r") <= k).select("_offered", "_name")
    return found.unionByName(opened.select("_ask", "_offered").join(low, "_offered")).distinct()


def candidates(listings: DataFrame, products: DataFrame, key: list[str], k: int, prefixes: list[str]) -> DataFrame:
    """The k best products per listing: exact set code, language, packaging, then similarity, then id.

    If no product of the category has the listing's code and the code has a real prefix, the best
    product with that code of any category comes before them (``is_fallback``).  Pass only the
    listings that are wanted: nothing here depends on the others.  Asks and their answers are written
    and read again, as both are needed several times."""
    mine = listings.select(*key, "raw_name", *_ASKED)
    asks = written(mine.drop(*key).distinct(), "asks").withColumns({"_asked": F.struct(*_ASKED), "_ask": F.struct("raw_name", *_ASKED), "_g": trigrams(F.col("raw_name"))})
    catalog = products.select("product_id", "name_canonical", F.col("category_slug").alias("p_category"), F.col("set_code").alias("p_set_code"), F.col("language").alias("p_language"), F.col("packaging").alias("p_packaging"))
    within = _best(asks, catalog, "category_slug", "p_category", k).withColumn("is_fallback", F.lit(False))
    held = catalog.select(F.col("p_category").alias("category_slug"), F.col("p_set_code").alias("cls_set_code")).distinct()
    lost = asks.filter(F.col("category_slug").isNotNull() & F.col("cls_set_code").rlike(f"^({'|'.join(prefixes)})")).join(held, ["category_slug", "cls_set_code"], "left_anti").select(asks.columns)
    other = _best(lost, catalog, "cls_set_code", "p_set_code", 1).withColumn("is_fallback", F.lit(True))
    order = Window.partitionBy("_ask").orderBy(F.desc("is_fallback"), "rank")
    both = within.unionByName(other).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    answers = written(both.withColumn("rank", F.col("_place")).drop("_place", "_asked"), "answers")
    return mine.withColumn("_ask", F.struct("raw_name", *_ASKED)).join(answers, "_ask").drop("_ask")


def evidence(pairs: DataFrame, singles: DataFrame, ambiguous: Column) -> DataFrame:
    """Flags of listing and candidate.  ``set_code_match`` is null unless both have a code."""
    pairs = pairs.join(singles.select("category_slug", F.lit(True).alias("_single")), "category_slug", "left")
    return pairs.select(
        "*",
        (F.lower(F.trim("raw_name")) == F.lower(F.trim("name_canonical"))).alias("exact_name"),
        (F.col("p_set_code") == F.col("cls_set_code")).alias("set_code_match"),
        F.col("cls_language").isNotNull().alias("language_known"),
        is_true(F.col("p_language") == F.col("cls_language")).alias("language_match"),
        (F.col("cls_packaging").isNull() | is_true(F.col("p_packaging") == F.col("cls_packaging"))).alias("packaging_match"),
        ambiguous.alias("quantity_ambiguous"),
        is_true(F.col("_single")).alias("single_product"),
    ).drop("_single")


def decision() -> Column:
    """The status of a listing whose best candidate has the evidence columns; the first rule wins."""
    c = F.col
    return first_case([
        (is_true(c("exact_name")), F.lit("confirmed")),
        (is_true(~c("set_code_match")), F.lit("unmatched")),
        (c("single_product") & ~c("is_fallback") & (~c("language_known") | c("language_match")), F.lit("confirmed")),
        (c("set_code_match").isNull() & is_true(c("score") < REVIEW), F.lit("unmatched")),
        (is_true(c("set_code_match")) & ~c("is_fallback") & c("language_match") & c("packaging_match") & ~c("quantity_ambiguous"), F.lit("confirmed")),
        (c("language_match") & is_true(c("score") > CONFIRMED), F.lit("confirmed")),
    ], F.lit("needs_review"))


def motive() -> Column:
    """Why a listing needs review, as a label (fixed wording)."""
    c, two = F.col, F.format_string("%.2f", F.col("score"))
    return first_case([
        (c("product_id").isNull(), F.lit("sin_candidato_en_la_categoria")),
        (is_true(c("exact_name")), F.lit("nombre_exacto (debería estar confirmed -- revisar)")),
        (is_true(~c("set_code_match")), F.lit("set_code_no_coincide")),
        (c("single_product") & ~c("is_fallback") & (~c("language_known") | c("language_match")), F.lit("categoria_unico_sku (debería estar confirmed -- revisar)")),
        (c("set_code_match").isNull() & c("score").isNull(), F.lit("sin_set_code_sin_candidato")),
        (c("set_code_match").isNull() & (c("score") < REVIEW), F.concat(F.lit("sin_set_code_similarity_baja_"), two)),
        (c("set_code_match").isNull() & (c("score") > CONFIRMED) & c("language_match"), F.lit("sin_set_code_deberia_confirmar (revisar)")),
        (c("set_code_match").isNull(), F.concat(F.lit("sin_set_code_similarity_media_"), two)),
        (c("is_fallback"), F.lit("candidato_solo_por_fallback_cross_categoria")),
        (~c("language_known"), F.lit("idioma_no_detectado_en_raw_name")),
        (~c("language_match"), F.concat(F.lit("idioma_no_coincide(clasificado="), c("cls_language"), F.lit(",candidato="), F.coalesce("p_language", F.lit("None")), F.lit(")"))),
        (~c("packaging_match"), F.concat(F.lit("packaging_no_coincide(clasificado="), c("cls_packaging"), F.lit(",candidato="), F.coalesce("p_packaging", F.lit("None")), F.lit(")"))),
        (c("quantity_ambiguous"), F.lit("cantidad_ambigua")),
    ], F.lit("motivo_desconocido (revisar decide())"))


def rematch(listings: DataFrame, pairs_with_evidence: DataFrame, key: list[str], not_applicable: Column) -> DataFrame:
    """New status of every listing that is not confirmed yet.  Product and score stay with confirmed
    ones only; a listing without category or candidate is unmatched.  Candidates of confirmed
    listings are not needed: see ``open_listings``."""
    best = pairs_with_evidence.filter("rank = 1").select(*key, decision().alias("_status"), "product_id", "score")
    open_ones = open_listings(listings).withColumn("_out", not_applicable).join(best, key, "left")
    status = F.when(F.col("_out"), "not_applicable").otherwise(F.coalesce("_status", F.lit("unmatched")))
    good = status == "confirmed"
    return open_ones.select(*key, status.alias("new_status"), F.when(good, F.col("product_id")).alias("product_id"), F.when(good, F.col("score")).alias("score"))


def open_listings(listings: DataFrame) -> DataFrame:
    return listings.filter("match_status <> 'confirmed'")


def rematched_state(listings: DataFrame, decided: DataFrame, key: list[str]) -> DataFrame:
    """The listings after ``rematch``: status, product and score (``match_confidence``) are written back
    to those it decided on, confirmed listings are never touched."""
    d = decided.select(*(F.col(c).alias(f"_{c}") for c in key), "new_status", F.col("product_id").alias("_product"), F.col("score").alias("_score"), F.lit(True).alias("_done"))
    joined = listings.join(d, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left")
    new = {"match_status": "new_status", "product_id": "_product", "match_confidence": "_score"}
    return joined.select(*(F.when(F.col("_done"), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in listings.columns))


def need_categories(products: DataFrame, category: str = "category_slug") -> DataFrame:
    """``products``, unless no row has a category: then matching would leave every listing unmatched."""
    if products.filter(F.col(category).isNotNull()).isEmpty():
        raise RuntimeError("the catalog has no categories: seed it first")
    return products


def catalog_gaps(listings: DataFrame, products: DataFrame, prefixes: list[str], least_stores: int = 2, kind: str = "category_slug", main_set: str | None = None) -> DataFrame:
    """What at least so many stores sell and the catalog lacks: groups of ``kind`` (category or type),
    code, language and packaging (nulls are a value), most stores first if sorted by ``n_stores``.

    A group is no gap if a product of its category has its code and packaging, nor, for codes with a
    real prefix, if one of any category has.  The language belongs to the group but not to the checks.
    With ``main_set``, the column's largest value in the group is kept."""
    keys = list(dict.fromkeys([kind, "category_slug", "cls_set_code", "cls_language", "cls_packaging"]))
    more = [F.max(main_set).alias(main_set)] if main_set else []
    g = listings.groupBy(*keys).agg(F.countDistinct("store_id").alias("n_stores"), *more).filter(F.col("n_stores") >= least_stores).alias("g")
    p = products.select("category_slug", "set_code", "packaging").distinct().alias("p")
    packaging = F.col("g.cls_packaging").eqNullSafe(F.col("p.packaging"))
    missing = g.join(p, (F.col("g.category_slug") == F.col("p.category_slug")) & F.col("g.cls_set_code").eqNullSafe(F.col("p.set_code")) & packaging, "left_anti")
    real = F.col("g.cls_set_code").rlike(f"^({'|'.join(prefixes)})")
    return missing.join(p, real & (F.col("g.cls_set_code") == F.col("p.set_code")) & packaging, "left_anti")


def outside_gaps(listings: DataFrame, gaps: DataFrame) -> DataFrame:
    """Listings whose group is no gap."""
    keys = ["category_slug", "cls_set_code", "cls_language", "cls_packaging"]
    left, right = listings.alias("l"), gaps.select(*keys).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same, "left_anti")


def _prefix(names: DataFrame, name: str, frequency: DataFrame, least: float) -> DataFrame:
    """(name, trigram): of each name's trigrams in order of rarity the first n - floor(least * n), one of
    which every name more similar than ``least`` has among its own."""
    grams = names.select(name, F.explode(trigrams(F.col(name))).alias("_g")).join(frequency, "_g")
    ordered = grams.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("_n", "_g"))).alias("_s"))
    room = F.size("_s") - F.floor(F.size("_s") * least - 1e-9).cast("int")
    return ordered.select(name, F.explode(F.transform(F.slice("_s", F.lit(1), room), lambda x: x["_g"])).alias("_g"))


def similar_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, least: float) -> DataFrame:
    """All pairs of names more similar than ``least``, by an inverted index over each name's rare
    trigrams; names that meet there are compared in full.  Equal names are compared once.  Names
    without trigrams are similar to nothing."""
    a, b = left.select(F.col(left_name).alias("_a")).distinct(), right.select(F.col(right_name).alias("_b")).distinct()
    frequency = a.select(F.explode(trigrams(F.col("_a"))).alias("_g")).unionAll(b.select(F.explode(trigrams(F.col("_b"))))).groupBy("_g").agg(F.count("*").alias("_n"))
    met = _prefix(a, "_a", frequency, least).join(_prefix(b, "_b", frequency, least), "_g").select("_a", "_b").distinct()
    score = similarity(F.col("_ga"), F.col("_gb"))
    sized = met.withColumn("_ga", trigrams(F.col("_a"))).withColumn("_gb", trigrams(F.col("_b")))
    scores = sized.select("_a", "_b", score.alias("score")).filter(F.col("score") > least)
    names = left.select(left_id, F.col(left_name).alias("_a")).join(scores, "_a")
    return names.join(right.select(right_id, F.col(right_name).alias("_b")), "_b").select(left_id, right_id, "score")
