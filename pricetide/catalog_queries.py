"""Registered queries over the catalog, price and stock operators, each with its SQL."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import prices
from pricetide.functions.classify import category_of, classify, quantity_is_ambiguous
from pricetide.functions.tables import NOT_APPLICABLE_TYPES, SET_CODE_PREFIXES
from pricetide.operators import catalog, changes, ingest, matching, stock
from pricetide.plans.adapters import SQL, Domain
from pricetide.sources import payloads

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_KEY = ["store_id", "listed_id"]
_TODAY = dt.date(1998, 6, 15)
_TRIGRAMS = r"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


def query(sql: str | None):
    """Register a function of a ``Domain``; ``sql`` follows the adapter views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"with {SQL}" + sql
        return f

    return add


_CONFIRMED = """, agg as (
  select product_id, min(price) as min_price, count(distinct store_id) as n_stores, bool_or(stock_status = 'disponible') as available
  from store_product where match_status = 'confirmed' group by 1)
"""


def _priced(df: DataFrame) -> DataFrame:
    return df.withColumn("min_price", F.col("min_price").cast("double"))


_SHOWN = ("product_id", "name_canonical", "set_code", "language", "min_price", "n_stores", "available")


@query(_CONFIRMED + """select product_id, name_canonical, set_code, language, cast(min_price as double) as min_price, n_stores, available
from product join agg using (product_id) where language = 'EN' and min_price between 900 and 2000 order by product_id limit 20 offset 20""")
def catalog_search(d: Domain) -> DataFrame:
    f = catalog.ProductFilters(language="EN", min_price=Decimal(900), max_price=Decimal(2000), page=2)
    return _priced(catalog.search(d.product, d.store_product, f).select(*_SHOWN))


@query(_CONFIRMED + """select product_id, name_canonical, set_code, language, cast(min_price as double) as min_price, n_stores, available
from product join agg using (product_id)""")
def catalog_all(d: Domain) -> DataFrame:
    return _priced(catalog.matching_products(d.product, d.store_product, catalog.ProductFilters()).select(*_SHOWN))


@query(_CONFIRMED + "select count(*) as total from product join agg using (product_id) where is_hot and packaging is not null")
def catalog_total(d: Domain) -> DataFrame:
    return catalog.matching_products(d.product, d.store_product, catalog.ProductFilters(is_hot=True)).agg(F.count("*").alias("total"))


@query(_CONFIRMED + f""", q as (select {_TRIGRAMS.format("'promo brass brand 12'")} as g), s as (
  select *, len(list_intersect({_TRIGRAMS.format("name_canonical")}, g)) as i, len({_TRIGRAMS.format("name_canonical")}) + len(g) as n from product, q)
select product_id, round(i / (n - i), 9) as score from s join agg using (product_id) where i / (n - i) > 0.2""")
def catalog_search_fuzzy(d: Domain) -> DataFrame:
    f = catalog.ProductFilters(text="promo brass brand 12")
    return catalog.matching_products(d.product, d.store_product, f).select("product_id", F.round("score", 9).alias("score"))


@query("""select product_id, store_id, store_name, cast(price as double) as price, stock_status,
  row_number() over (partition by product_id order by price asc nulls last, store_id) as place
from store_product join store using (store_id) where match_status = 'confirmed'""")
def product_listings(d: Domain) -> DataFrame:
    return catalog.product_listings(d.store_product, d.store).select("product_id", "store_id", "store_name", F.col("price").cast("double").alias("price"), "stock_status", F.col("place").cast("long").alias("place"))


@query("""select product_id, scraped_date, cast(min(price) as double) as price, case when bool_or(stock_status = 'disponible') then 'disponible' else 'agotado' end as stock_status
from price_history group by 1, 2""")
def daily_curve(d: Domain) -> DataFrame:
    return catalog.daily_curve(d.price_history).withColumn("price", F.col("price").cast("double"))


@query("select game_slug, array_to_string(list_sort(list(distinct category_slug)), ',') as children from product group by 1")
def category_tree(d: Domain) -> DataFrame:
    return catalog.category_tree(d.product, "game_slug", "category_slug").withColumn("children", F.array_join("children", ","))


_DEALS = """, now as (
  select product_id, min(price) as price, bool_or(stock_status = 'disponible') as available, arg_min(store_name, price * 1000000 + store_id) as store_name
  from store_product join store using (store_id) where match_status = 'confirmed' group by 1),
before as (select product_id, min(price) as price_before from price_history where scraped_date = date '{day}' - {days} group by 1)
select product_id, name_canonical, store_name, cast(price as double) as price, cast(price_before as double) as price_before,
  cast(round((price_before - price) * 100 / price_before, 1) as double) as drop_percent
from now join before using (product_id) join product using (product_id) where available and price < price_before
"""


@query(_DEALS.format(day="1998-06-15", days=7))
def deals(d: Domain) -> DataFrame:
    out = catalog.deals(d.product, d.store_product, d.store, d.price_history, _TODAY)
    return out.select("product_id", "name_canonical", "store_name", *(F.col(c).cast("double").alias(c) for c in ("price", "price_before", "drop_percent")))


@query(_DEALS.format(day="1998-06-15", days=30) + " order by drop_percent desc, product_id limit 10")
def deals_top(d: Domain) -> DataFrame:
    out = catalog.deals(d.product, d.store_product, d.store, d.price_history, _TODAY, days=30, limit=10)
    return out.select("product_id", "name_canonical", "store_name", *(F.col(c).cast("double").alias(c) for c in ("price", "price_before", "drop_percent")))


_TURNS = """, turns as (
  select *, lag(stock_status) over (partition by listing_id order by ts, event_id) as before from signal),
restock as (select listing_id, ts, event_id from turns where before = 'agotado' and stock_status = 'disponible')
"""


@query(_TURNS + "select listing_id, event_id from restock")
def restock_transitions(d: Domain) -> DataFrame:
    return stock.transitions(d.signal).select("listing_id", "event_id")


def _events(d: Domain) -> DataFrame:
    """Restocks as events of a product in a store."""
    n = d.raw("part").count()
    m = d.raw("supplier").count()
    return stock.transitions(d.signal).select("event_id", F.col("ts").cast("timestamp_ntz").alias("detected_at"), (F.col("listing_id") * 13 % n + 1).alias("product_id"), (F.col("listing_id") % m + 1).alias("store_id"))


_EVENTS = _TURNS + ", ev as (select event_id, ts as detected_at, listing_id * 13 % (select count(*) from part) + 1 as product_id, listing_id % (select count(*) from supplier) + 1 as store_id from restock)\n"


@query(_EVENTS + "select event_id, product_id, name_canonical, store_name from ev join product using (product_id) join store using (store_id) where detected_at >= timestamp '2024-01-20 00:00:00' - interval 240 hour")
def restock_feed(d: Domain) -> DataFrame:
    return stock.restock_feed(_events(d), d.product, d.store, dt.datetime(2024, 1, 20), 240).select("event_id", "product_id", "name_canonical", "store_name")


@query(_EVENTS + "select event_id, subscriber_id from ev e join subscription s on e.product_id = s.product_id and (s.store_id is null or s.store_id = e.store_id)")
def subscriber_fan_out(d: Domain) -> DataFrame:
    return stock.fan_out(_events(d), d.subscription).select("event_id", "subscriber_id")


@query(""", runs as (select *, stock_status = 'agotado' as failed, sum(case when stock_status = 'agotado' then 0 else 1 end) over (partition by listing_id order by ts, event_id) as island from signal),
n as (select *, sum(cast(failed as bigint)) over (partition by listing_id, island order by ts, event_id) as failures from runs)
select event_id, cast(failures as bigint) as failures, failed and failures >= 3 as paused from n""")
def store_failures(d: Domain) -> DataFrame:
    runs = d.signal.withColumn("failed", F.col("stock_status") == "agotado")
    return stock.failure_runs(runs, "listing_id", "ts", "event_id", "failed").select("event_id", "failures", F.col("backoff_until").isNotNull().alias("paused"))


_GAPS = """, grp as (select category_slug, cls_set_code, cls_language, cls_packaging, count(distinct store_id) as n_stores from listing group by 1, 2, 3, 4 having count(distinct store_id) >= 2),
gaps as (select * from grp g where not exists (select 1 from product p where p.category_slug = g.category_slug and p.set_code is not distinct from g.cls_set_code and p.packaging is not distinct from g.cls_packaging)
  and not (regexp_matches(coalesce(g.cls_set_code, ''), '^(PREFIXES)') and exists (select 1 from product p where p.set_code = g.cls_set_code and p.packaging is not distinct from g.cls_packaging)))
"""


_GAPS = _GAPS.replace("PREFIXES", "|".join(SET_CODE_PREFIXES))


@query(_GAPS + "select * from gaps")
def catalog_gaps(d: Domain) -> DataFrame:
    return matching.catalog_gaps(d.listing, d.product, SET_CODE_PREFIXES)


_SHIFTED = _GAPS.replace("grp as (select category_slug, cls_set_code", "shifted as (select store_id, category_slug, case when cls_set_code like 'OP%' and listed_id % 3 = 0 then replace(cls_set_code, 'OP', 'VOL') when cls_set_code = 'OP99' then 'OP0' || (1 + listed_id % 9) else cls_set_code end as cls_set_code, cls_language, cls_packaging, match_status from listing where match_status <> 'confirmed'), grp as (select category_slug, cls_set_code").replace("from listing group by 1, 2, 3, 4", "from shifted group by 1, 2, 3, 4")


@query(_SHIFTED + "select category_slug, cls_set_code, cls_language, cls_packaging, n_stores, 'main ' || cls_set_code as main_set from gaps")
def catalog_gaps_across_categories(d: Domain) -> DataFrame:
    """Open listings, whose codes are those of other categories, or of a prefix that no publisher assigns."""
    code = F.when(F.col("cls_set_code").startswith("OP") & (F.col("listed_id") % 3 == 0), F.replace("cls_set_code", F.lit("OP"), F.lit("VOL"))).when(F.col("cls_set_code") == "OP99", F.concat(F.lit("OP0"), 1 + F.col("listed_id") % 9)).otherwise(F.col("cls_set_code"))
    listings = matching.open_listings(d.listing).withColumn("cls_set_code", code).withColumn("main_set", F.concat(F.lit("main "), "cls_set_code"))
    return matching.catalog_gaps(listings, d.product, SET_CODE_PREFIXES, main_set="main_set")


@query(_GAPS + """select store_id, listed_id from listing l where match_status = 'needs_review' and not exists (
  select 1 from gaps g where g.category_slug is not distinct from l.category_slug and g.cls_set_code is not distinct from l.cls_set_code and g.cls_language is not distinct from l.cls_language and g.cls_packaging is not distinct from l.cls_packaging)""")
def review_outside_gaps(d: Domain) -> DataFrame:
    return matching.outside_gaps(d.listing.filter("match_status = 'needs_review'"), matching.catalog_gaps(d.listing, d.product, SET_CODE_PREFIXES)).select(*_KEY)


@query("select name_canonical from product group by 1 having count(*) = 1")
def single_product_categories(d: Domain) -> DataFrame:
    return matching.single_product_categories(d.product, "name_canonical")


_PAIRS = f""", li as (select *, {_TRIGRAMS.format("raw_name")} as g, case when cls_language in ('EN', 'JP', 'ES') then cls_language end as lang from listing),
pr as (select *, {_TRIGRAMS.format("name_canonical")} as h from product),
met as (
  select store_id, listed_id, raw_name, l.category_slug, cls_set_code, cls_language, cls_packaging, match_status, product_id, name_canonical, p.set_code as p_set_code, p.language as p_language, p.packaging as p_packaging,
    coalesce(p.set_code = cls_set_code, false) as code_hit, coalesce(p.language = lang, false) as language_hit, coalesce(p.packaging = cls_packaging, false) as packaging_hit,
    p.category_slug <> l.category_slug as is_fallback, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) as score
  from li l join pr p on p.category_slug = l.category_slug
  union all
  select store_id, listed_id, raw_name, l.category_slug, cls_set_code, cls_language, cls_packaging, match_status, product_id, name_canonical, p.set_code, p.language, p.packaging,
    true, coalesce(p.language = lang, false), coalesce(p.packaging = cls_packaging, false), true, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))
  from li l join pr p on p.set_code = l.cls_set_code and not exists (select 1 from product x where x.category_slug = l.category_slug and x.set_code = l.cls_set_code)
), cut as (
  select *, row_number() over (partition by store_id, listed_id, is_fallback order by code_hit desc, language_hit desc, packaging_hit desc, score desc, product_id) as r from met
), pairs as (
  select *, cast(row_number() over (partition by store_id, listed_id order by is_fallback desc, r) as integer) as rank from cut where r <= 3 and (not is_fallback or r = 1) qualify rank <= 3
)
"""


def _pairs(d: Domain) -> DataFrame:
    return matching.candidates(d.listing, d.product, _KEY, 3, SET_CODE_PREFIXES)


@query(_PAIRS + "select store_id, listed_id, rank, product_id, is_fallback, round(score, 9) as score from pairs")
def match_candidates(d: Domain) -> DataFrame:
    return _pairs(d).select(*_KEY, "rank", "product_id", "is_fallback", F.round("score", 9).alias("score"))


_DECIDED = _PAIRS + """, ev as (
  select *, lower(trim(raw_name)) = lower(trim(name_canonical)) as exact_name, p_set_code = cls_set_code as scm, cls_language is not null as lk, coalesce(p_language = cls_language, false) as lm,
    cls_packaging is null or coalesce(p_packaging = cls_packaging, false) as pm, raw_name like '%x12' as qa,
    category_slug in (select category_slug from product group by 1 having count(*) = 1) as one
  from pairs where rank = 1 and match_status <> 'confirmed'
), decided as (
  select *, case when exact_name then 'confirmed' when not coalesce(scm, true) then 'unmatched' when one and not is_fallback and (not lk or lm) then 'confirmed' when scm is null and score < 0.35 then 'unmatched'
    when coalesce(scm, false) and not is_fallback and lm and pm and not qa then 'confirmed' when lm and score > 0.6 then 'confirmed' else 'needs_review' end as new_status from ev)
"""


def _evidence(d: Domain) -> DataFrame:
    # these listings are sold by the piece, so a quantity is a bundle
    pairs = matching.candidates(matching.open_listings(d.listing), d.product, _KEY, 3, SET_CODE_PREFIXES)
    return matching.evidence(pairs, matching.single_product_categories(d.product), quantity_is_ambiguous(F.col("raw_name"), F.lit("PLAYMAT"), F.lit("sobre")))


def _rematch(d: Domain) -> DataFrame:
    return matching.rematch(d.listing, _evidence(d), _KEY, F.lit(False))


@query(_DECIDED + "select store_id, listed_id, new_status, case when new_status = 'confirmed' then product_id end as product_id, case when new_status = 'confirmed' then round(score, 9) end as score from decided")
def match_decisions(d: Domain) -> DataFrame:
    return _rematch(d).withColumn("score", F.round("score", 9))


@query(_DECIDED + "select new_status, count(*) as n from decided group by 1")
def match_counts(d: Domain) -> DataFrame:
    return _rematch(d).groupBy("new_status").agg(F.count("*").alias("n"))


@query(_DECIDED + """select store_id, listed_id, case when exact_name then 'nombre_exacto (debería estar confirmed -- revisar)' when not coalesce(scm, true) then 'set_code_no_coincide'
  when one and not is_fallback and (not lk or lm) then 'categoria_unico_sku (debería estar confirmed -- revisar)' when scm is null and score < 0.35 then 'sin_set_code_similarity_baja_' || printf('%.2f', score)
  when scm is null and score > 0.6 and lm then 'sin_set_code_deberia_confirmar (revisar)' when scm is null then 'sin_set_code_similarity_media_' || printf('%.2f', score)
  when is_fallback then 'candidato_solo_por_fallback_cross_categoria' when not lk then 'idioma_no_detectado_en_raw_name'
  when not lm then 'idioma_no_coincide(clasificado=' || cls_language || ',candidato=' || coalesce(p_language, 'None') || ')'
  when not pm then 'packaging_no_coincide(clasificado=' || cls_packaging || ',candidato=' || coalesce(p_packaging, 'None') || ')' when qa then 'cantidad_ambigua' else 'motivo_desconocido (revisar decide())' end as motive from decided""")
def review_motives(d: Domain) -> DataFrame:
    return _evidence(d).filter("rank = 1").select(*_KEY, matching.motive().alias("motive"))


@query(_PAIRS + """, top as (select store_id, listed_id, string_agg(rank || ':' || product_id, ',' order by rank) as candidates, max(score) filter (where rank = 1) as best from pairs group by 1, 2)
select store_id, listed_id, candidates from listing join top using (store_id, listed_id) where match_status = 'needs_review' and best >= 0.4""")
def review_queue(d: Domain) -> DataFrame:
    waiting = d.listing.filter("match_status = 'needs_review'")
    rows = changes.review_queue(matching.candidates(waiting, d.product, _KEY, 3, SET_CODE_PREFIXES), waiting, _KEY, low=0.4)
    return rows.select(*_KEY, F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["product_id"].cast("string"))), ",").alias("candidates"))


@query(_PAIRS + """, ch as (
  select store_id, listed_id, case listed_id % 3 when 0 then 'confirm' when 1 then 'reject' else 'reopen' end as action, case when store_id % 10 = 0 then -1 else listed_id end as chosen_id, match_status from listing),
res as (select c.*, p.score as score, case when action = 'confirm' and chosen_id = -1 then 422 when action = 'reopen' and c.match_status <> 'confirmed' then 409 else 200 end as code from ch c left join pairs p on p.store_id = c.store_id and p.listed_id = c.listed_id and p.product_id = c.chosen_id)
select store_id, listed_id, action, code, case when code = 200 then case action when 'confirm' then 'confirmed' when 'reject' then 'not_applicable' else 'needs_review' end else match_status end as new_status,
  case when code <> 200 then listed_id when action = 'confirm' then chosen_id end as new_product_id, cast(case when code = 200 and action = 'confirm' then round(score, 6) when code = 200 and action = 'reopen' then null else 0.5 end as double) as new_confidence from res""")
def review_changes(d: Domain) -> DataFrame:
    state = d.listing.withColumn("product_id", F.col("listed_id")).withColumn("match_confidence", F.lit(0.5))
    pick = F.when(F.col("listed_id") % 3 == 0, "confirm").when(F.col("listed_id") % 3 == 1, "reject").otherwise("reopen")
    asked = d.listing.select(*_KEY, pick.alias("action"), F.when(F.col("store_id") % 10 == 0, F.lit(-1)).otherwise(F.col("listed_id")).alias("chosen_id"))
    out = changes.apply_reviews(state, asked, _pairs(d), d.product, _KEY)
    return out.withColumn("new_confidence", F.round("new_confidence", 6))


@query(f""", a as (select distinct p_name as a, {_TRIGRAMS.format("p_name")} as g from part), b as (select distinct p_type || ' ' || p_name as b, {_TRIGRAMS.format("p_type || ' ' || p_name")} as h from part),
s as (select a, b, len(list_intersect(g, h)) as i, len(g) + len(h) as n from a, b)
select a, b, round(i / (n - i), 9) as score from s where i / (n - i) > 0.5""")
def similar_names(d: Domain) -> DataFrame:
    left = d.raw("part").select(F.col("p_name").alias("a")).distinct()
    right = d.raw("part").select(F.concat_ws(" ", "p_type", "p_name").alias("b")).distinct()
    out = matching.similar_names(left, right, "a", "b", "a", "b", 0.5)
    return out.select("a", "b", F.round("score", 9).alias("score"))


def _batch(d: Domain) -> DataFrame:
    """Scraped rows with conflicts and gaps: a URL per part and store."""
    x = d.raw("lineitem")
    url = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat_ws("/", F.lit("u"), F.col("l_partkey"), F.col("l_orderkey") % 1000))
    variant = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))
    return x.select(F.col("l_suppkey").alias("store_id"), url.alias("store_url"), variant.alias("raw_variant"), F.repeat(F.col("l_returnflag"), F.col("l_quantity").cast("int") * 12).alias("raw_name"), F.when(F.col("l_linestatus") == "O", "DISPONIBLE").otherwise("???").alias("stock_status"))


@query(""", rows as (
  select l_suppkey as store_id, 'u/' || l_partkey || '/' || l_orderkey % 1000 as store_url, case when l_linenumber % 2 = 0 then l_returnflag end as raw_variant, length(l_returnflag) * cast(l_quantity as int) * 12 as len, l_linestatus from lineitem where l_linenumber <> 7),
bad as (select distinct store_id from (select store_id from rows group by store_id, store_url, raw_variant having count(*) > 1))
select store_id, count(*) as n, cast(sum(least(len, 500)) as bigint) as name_chars, count(*) filter (where l_linestatus = 'O') as available from rows where store_id not in (select store_id from bad) group by 1""")
def ingest_accepted(d: Domain) -> DataFrame:
    rows = ingest.accepted(_batch(d))
    return rows.groupBy("store_id").agg(F.count("*").alias("n"), F.sum(F.length("raw_name")).alias("name_chars"), F.count_if(F.col("stock_status") == "disponible").alias("available"))


@query(""", old as (select store_id, product_id, price, stock_status, match_status from price_history qualify row_number() over (partition by store_id, product_id order by scraped_date, l_orderkey, l_linenumber) = 1),
new as (select store_id, product_id, price, stock_status from store_product)
select store_id, product_id, cast(coalesce(n.price, o.price) as double) as price, coalesce(n.stock_status, o.stock_status) as stock_status, o.match_status from old o left join new n using (store_id, product_id)""")
def snapshot_merge(d: Domain) -> DataFrame:
    first = Window.partitionBy("store_id", "product_id").orderBy("scraped_date", "seq")
    old = d.price_history.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("store_id", "product_id", "price", "stock_status", "match_status")
    new = d.store_product.select("store_id", "product_id", "price", "stock_status", F.lit("lost").alias("match_status"))
    merged = ingest.merge_snapshot(old, new, ["store_id", "product_id"], ["price", "stock_status"])
    return merged.withColumn("price", F.col("price").cast("double"))


@query(""", b as (select *, l_orderkey % 2 as new from obs),
s as (select * from b qualify row_number() over (partition by store_id, product_id, scraped_date order by new desc, l_orderkey desc, l_linenumber desc) = 1)
select store_id, product_id, scraped_date, cast(price as double) as price from s""")
def daily_prices(d: Domain) -> DataFrame:
    o = d.observation
    out = ingest.daily_prices(o.filter("seq.l_orderkey % 2 = 0"), o.filter("seq.l_orderkey % 2 = 1"), ["store_id", "product_id", "scraped_date"], ["seq"])
    return out.select("store_id", "product_id", "scraped_date", F.col("price").cast("double").alias("price"))


@query(""", cur as (select * from store_product where match_status = 'confirmed'), prev as (select store_id, product_id, stock_status from price_history qualify row_number() over (partition by store_id, product_id order by scraped_date, l_orderkey, l_linenumber) = 1)
select store_id, product_id from cur c join prev p using (store_id, product_id) where p.stock_status = 'agotado' and c.stock_status = 'disponible'""")
def restock_on_ingest(d: Domain) -> DataFrame:
    first = Window.partitionBy("store_id", "product_id").orderBy("scraped_date", "seq")
    previous = d.price_history.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("store_id", F.col("product_id").alias("listed_id"), "product_id", "stock_status")
    now = d.store_product.filter("match_status = 'confirmed'").select("store_id", F.col("product_id").alias("listed_id"), "stock_status")
    return stock.restock_events(previous, now, ["store_id", "listed_id"]).select("store_id", "product_id")


_RELEASES = """, rel as (
  select p_partkey, case p_partkey % 4 when 0 then 'Booster Pack: ' when 1 then 'Premium Booster: ' when 2 then 'Starter Deck ' else 'Playmat ' end as head, p_name as tail, p_partkey % 4 as k, 'XX-' || p_size as code from part),
v as (
  select *, head || tail as name, 'sobre' as packaging from rel
  union all select *, case k when 0 then 'Booster Box: ' else 'Premium Booster Box: ' end || tail, 'display' from rel where k < 2
  union all select *, 'Starter Deck Display ' || tail, 'display' from rel where k = 2
  union all select *, case k when 0 then 'Booster Box Case: ' || tail || ' (x12)' else 'Premium Booster Box Case: ' || tail || ' (x10)' end, 'case' from rel where k < 2),
seed as (select name || ' ' || code || ' ' || language as name_canonical, packaging, language, p_partkey from v join (values ('EN'), ('JP')) l(language) on language = 'EN' or k < 3)
"""


def _seed(d: Domain) -> DataFrame:
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, "Booster Pack: ").when(k == 1, "Premium Booster: ").when(k == 2, "Starter Deck ").otherwise("Playmat ")
    slug = F.when(k == 0, "one-piece").when(k == 1, "premium-booster-box").when(k == 2, "starter-deck").otherwise("playmat")
    return ingest.expand_catalog(d.raw("part").select("p_partkey", F.concat(head, F.col("p_name")).alias("name"), F.concat(F.lit("XX-"), F.col("p_size"), F.lit(" / YY-1")).alias("code"), slug.alias("category_slug")))


@query(_RELEASES + "select name_canonical, packaging, language, count(*) as n from seed group by 1, 2, 3")
def seed_catalog(d: Domain) -> DataFrame:
    return _seed(d).groupBy("name_canonical", "packaging", "language").agg(F.count("*").alias("n"))


@query(_RELEASES + """, s as (select distinct name_canonical, packaging, language from seed), c as (select distinct name_canonical, case when language = 'JP' and packaging = 'case' then 'sobre' else packaging end as packaging from seed where name_canonical not like 'Playmat%')
select name_canonical, case when c.name_canonical is null then 'inserted' when c.packaging = s.packaging then 'same' else 'updated' end as action from s left join c using (name_canonical)""")
def seed_actions(d: Domain) -> DataFrame:
    seed = _seed(d).select("name_canonical", "packaging", "language").distinct()
    have = seed.filter(~F.col("name_canonical").startswith("Playmat")).withColumn("packaging", F.when((F.col("language") == "JP") & (F.col("packaging") == "case"), "sobre").otherwise(F.col("packaging")))
    return ingest.seed_actions(have, seed, ["name_canonical"], ["packaging"]).select("name_canonical", "action")


@query(""", u as (select distinct page_id % 5 as store_id, url from pages where starts_with(url, 'http') and regexp_matches(lower(url), 'page|item|p')), k as (select url from pages where page_id % 3 = 0)
select store_id, url, row_number() over (partition by store_id order by url) as place from u where url not in (select url from k) qualify place <= 30""")
def sitemap_new_urls(d: Domain) -> DataFrame:
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    found = payloads.sitemap(d.raw("pages").select((F.col("page_id") % 5).alias("store_id"), xml.alias("xml"))).withColumnRenamed("loc", "url")
    known = d.raw("pages").filter("page_id % 3 = 0").select("url")
    return ingest.new_urls(found, known, "http", ["page", "item", "p"]).withColumn("place", F.col("place").cast("long"))


@query("""select page_id, try_cast(nullif(regexp_extract(url, '[?&/]page[=/](\\d+)', 1), '') as integer) as page from pages""")
def page_numbers(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", payloads.page_number(F.col("url")).alias("page"))


@query("""select p_partkey as id, p_name || ' ' || v as name, case when v = 1 then 'Default Title' else 'V' || v end as variant, cast(round(p_retailprice, 2) as double) as price,
  case when (p_size + v) % 2 = 0 then 'disponible' else 'agotado' end as stock_status, case when p_size % 2 = 0 then 'a, b' else p_brand end as tags
from part, (values (1), (2)) t(v)""")
def shopify_rows(d: Domain) -> DataFrame:
    tags = F.when(F.col("p_size") % 2 == 0, F.lit('["a","b"]')).otherwise(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')))
    variants = F.concat_ws(",", *(F.format_string('{"title":"%s","price":"%s","available":%s,"sku":"s"}', F.lit("Default Title" if v == 1 else f"V{v}"), F.round("p_retailprice", 2).cast("decimal(12,2)").cast("string"), ((F.col("p_size") + v) % 2 == 0).cast("string")) for v in (1, 2)))
    payload = F.concat(F.lit('{"products":[{"id":'), F.col("p_partkey"), F.lit(',"title":"'), F.col("p_name"), F.lit('","handle":"h","tags":'), tags, F.lit(',"images":[],"variants":['), variants, F.lit("]}]}"))
    rows = payloads.shopify(d.raw("part").select(F.lit("https://shop.example").alias("store_url"), payload.alias("payload")))
    number = F.when(F.col("variant") == "Default Title", " 1").otherwise(" 2")
    return rows.select(F.col("id_product").cast("long").alias("id"), F.concat("name", number).alias("name"), "variant", "price", "stock_status", "tags")


@query("""select p_partkey as id, p_name as name, cast(round(p_retailprice * 100) as bigint) / 100.0::double as price, case when p_size % 3 = 0 then 'agotado' else 'disponible' end as stock_status from part where p_type = (select min(p_type) from part)""")
def woocommerce_rows(d: Domain) -> DataFrame:
    part = d.raw("part")
    wanted = part.agg(F.min("p_type").alias("t")).first().t
    payload = F.format_string('[{"id":%d,"name":"%s<b class=\\"x\\">leak","permalink":"u","sku":"","categories":[{"slug":"%s"}],"prices":{"price":"%d","currency_minor_unit":2},"stock_status":"%s","images":[]}]', "p_partkey", "p_name", F.lower("p_type"), F.round(F.col("p_retailprice") * 100).cast("long"), F.when(F.col("p_size") % 3 == 0, "outofstock").otherwise("instock"))
    rows = payloads.woocommerce(part.select(payload.alias("payload")), wanted)
    return rows.select(F.col("id_product").cast("long").alias("id"), "name", "price", "stock_status")


@query("""select p_partkey as id, p_name as name, cast(p_size as double) + 0.5 as price, case p_size % 3 when 0 then 'agotado' when 1 then 'disponible' else 'desconocido' end as stock_status from part""")
def json_ld_rows(d: Domain) -> DataFrame:
    seen = F.when(F.col("p_size") % 3 == 0, ',"availability":"https://schema.org/OutOfStock"').when(F.col("p_size") % 3 == 1, ',"availability":"http://schema.org/InStock"').otherwise("")
    offer = F.concat(F.lit('{"price":"'), F.col("p_size"), F.lit(',50 €"'), seen, F.lit("}"))
    offer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), offer, F.lit("]"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"offers":'), offer, F.lit("}"))).otherwise(offer)
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"BreadcrumbList"}</script><script type="application/ld+json">{"@type":"product","name":"'), F.col("p_name"), F.lit('","offers":'), offer, F.lit("}</script></html>"))
    return payloads.json_ld(d.raw("part").select(F.col("p_partkey").alias("id"), html.alias("html"))).select("id", "name", "price", "stock_status")


@query("""select p_partkey as id, p_name as name, cast(p_size as double) + 0.5 as price, case p_partkey % 3 when 0 then case when p_size % 3 = 0 then 'agotado' else 'disponible' end
  when 1 then case when p_size % 3 = 1 then 'disponible' else 'agotado' end else case p_size % 3 when 0 then 'agotado' when 1 then 'disponible' else 'desconocido' end end as stock_status from part""")
def html_card_rows(d: Domain) -> DataFrame:
    n, kind = F.col("p_partkey"), F.col("p_size") % 3
    words = F.when(kind == 0, "Agotado").when(kind == 1, "En stock").otherwise("")
    link = F.concat(F.lit('<a href="/p?product_id='), n, F.lit('">'), F.col("p_name"), F.lit(" <b></b></a>"))
    amount = F.concat(F.col("p_size"), F.lit(",50 €"))
    shapes = {
        "woocommerce": F.concat(F.lit('<ul><li class="product '), F.when(kind == 0, "outofstock").otherwise("instock"), F.lit('"><h3>'), link, F.lit('</h3><div class="price"><del>99,00 €</del> <span>'), amount, F.lit("</span></div>Agotado</li></ul>")),
        "prestashop": F.concat(F.lit('<article class="product-miniature" data-id-product="'), n, F.lit('"><h3 class="product-title">'), link, F.lit('</h3><span class="product-price" content="'), F.col("p_size"), F.lit('.5">1,00 €</span>'), F.when(kind == 1, '<span class="product-available">x</span>').otherwise("En stock"), F.lit("</article>")),
        "opencart": F.concat(F.lit('<div class="product-thumb"><h4>'), link, F.lit('</h4><p class="price">'), amount, F.lit("</p>"), words, F.lit("</div>"), F.lit('<div class="product-thumb"><h4></h4></div>')),
    }
    parts = [payloads.html_cards(d.spread("part").filter(n % 3 == k).select(n.alias("id"), page.alias("html")), kind) for k, (kind, page) in enumerate(shapes.items())]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("id", "name", "price", "stock_status")


@query("""select p_partkey as id, case p_partkey % 5 when 0 then cast(p_size as double) + 0.95 when 1 then cast(p_size as double) * 1000 + 234.5 when 2 then cast(p_size as double) + 0.5 when 3 then null else cast(p_size as double) end as price,
  case when p_partkey % 2 = 0 then cast(p_size as double) / 100 end as minor from part""")
def parsed_prices(d: Domain) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.col("p_size"), F.lit(",95€"))).when(k == 1, F.concat(F.lit("€ "), F.col("p_size"), F.lit(".234,50"))).when(k == 2, F.concat(F.col("p_size"), F.lit(".5"))).when(k == 3, F.lit("precio no disponible")).otherwise(F.col("p_size").cast("string"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("abc")
    return d.raw("part").select(F.col("p_partkey").alias("id"), prices.parse_price(text).alias("price"), prices.parse_minor_units(raw).alias("minor"))


#: Listing names built from a part's number and size, and what a reader makes of them: pattern, type, prefix, main set, packaging.
_NAMES = [
    ("Booster Box OP-%02d The Time of Battle", "ONE_PIECE", "OP", True, "display", "EN"),
    ("Sobre One Piece OP%02d (Japonés)", "ONE_PIECE", "OP", True, "sobre", "JP"),
    ("Lote %02d cartas sueltas One Piece", "LOTE_CARTAS", None, False, None, "EN"),
    ("Starter Deck ST-%02d", "STARTER_DECK", "ST", False, "sobre", "EN"),
    ("Premium Booster PRB-%02d Inglés x20", "PREMIUM_BOOSTER_BOX", "PRB", False, "display", "EN"),
    ("Extra Booster EB-%02d case", "EXTRA_BOOSTER", "EB", False, "case", "EN"),
    ("Playmat Vol.%02d", "PLAYMAT", "VOL", False, None, "EN"),
    ("Official Sleeves %02d - Castellano", "SLEEVES", "VOL", False, None, "ES"),
    ("Devil Fruits Collection DF-%02d", "DEVIL_FRUITS_COLLECTION", "DF", False, None, "EN"),
    ("Illustration Box IB-%02d non-english", "ILLUSTRATION_BOX", "VOL", False, None, None),
    ("Figura %02d coreano", "OTROS", None, False, None, "KR"),
    ("Carta promo OP-%02d", "PROMO_CARD", "OP", False, None, "EN"),
]


def _case(column: int) -> str:
    quoted = ["null" if n[column] is None else f"'{n[column]}'" for n in _NAMES]
    return "case p_partkey % 12 " + " ".join(f"when {k} then {v}" for k, v in enumerate(quoted)) + " end"


@query(f""", c as (select p_partkey, {_case(1)} as product_type, {_case(2)} || printf('%02d', p_size % 30 + 1) as set_code, {_case(5)} as language, {_case(4)} as packaging from part)
select p_partkey as id, product_type, set_code, language, case when product_type = 'ONE_PIECE' then set_code end as main_set, packaging,
  case when product_type in ({", ".join(f"'{x}'" for x in NOT_APPLICABLE_TYPES)}) then null else replace(lower(product_type), '_', '-') end as category_slug from c""")
def classified_listings(d: Domain) -> DataFrame:
    number = (F.col("p_size") % 30 + 1).cast("int")
    name = F.coalesce(*(F.when(F.col("p_partkey") % len(_NAMES) == k, F.format_string(n[0], number)) for k, n in enumerate(_NAMES)))
    rows = classify(d.raw("part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit(None).cast("string").alias("variant"), F.lit("figura").alias("tags")))
    return rows.select("id", "cls.*", category_of(F.col("cls.product_type")).alias("category_slug"))


@query("""select 'lang' as "column", lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2""")
def frequencies(d: Domain) -> DataFrame:
    return changes.frequencies(d.raw("documents"), ["lang", "source"])


@query("select set_code, store_id, cast(min(price) as double) as min_price from store_product join product using (product_id) group by 1, 2")
def cheapest_per_set(d: Domain) -> DataFrame:
    rows = d.store_product.join(d.product.select("product_id", "set_code"), "product_id")
    return changes.cheapest_per_set(rows, "set_code", "store_id", "price").withColumn("min_price", F.col("min_price").cast("double"))


@query("select o_orderpriority as label, o_orderkey as run_id from orders qualify row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) <= 20")
def latest_runs(d: Domain) -> DataFrame:
    runs = d.raw("orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return changes.latest_runs(runs, "label", "started_at").select("label", "run_id")


@query("""select subscriber_id, case when exists (select 1 from subscription e where e.subscriber_id % 2 = 0 and e.product_id = s.product_id and e.store_id is not distinct from s.store_id) then 409 else 201 end as code from subscription s""")
def subscription_requests(d: Domain) -> DataFrame:
    s = d.subscription
    return changes.add_subscriptions(s.filter("subscriber_id % 2 = 0"), s, ["product_id", "store_id"]).select("subscriber_id", "code")


@query("""select product_id, case when exists (select 1 from product q where q.game_slug = p.game_slug and q.name_canonical = p.name_canonical and q.product_id <> p.product_id) then 409 else 200 end as code from product p""")
def name_collisions(d: Domain) -> DataFrame:
    wanted = d.product.select("product_id", "game_slug", F.col("name_canonical").alias("new_name"))
    return changes.name_collisions(d.product, wanted).select("product_id", "code")
