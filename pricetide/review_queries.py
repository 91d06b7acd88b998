"""Registered queries over refresh, review, notification and detail-page operators, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.catalog_queries import _DECIDED, _KEY, ORACLE_SQL, QUERIES, _evidence, query  # noqa: F401 (all queries, these too)
from pricetide.functions import tables
from pricetide.functions.classify import category_of, classify
from pricetide.operators import catalog, changes, ingest, matching, refresh
from pricetide.plans.adapters import Domain
from pricetide.sources import payloads

_TODAY = dt.date(1998, 6, 15)

_HOT = """, hp as (select product_id, is_hot, case product_id % 3 when 1 then date '1998-06-14' when 2 then date '1998-06-15' end as hot_until from product),
known as (select store_id, website_url, product_id, 'u/' || product_id // 4 as store_url, case when product_id % 4 > 0 then 'V' || product_id % 4 end as raw_variant, case when (store_id + product_id) % 9 > 0 then 'S' || product_id end as store_sku, price, stock_status from store_product join store using (store_id)),
hot as (select k.* from known k join hp using (product_id) where is_hot and (hot_until is null or hot_until >= date '1998-06-15')),
wanted as (select store_id, website_url, store_url, count(*) as n_listings from hot group by 1, 2, 3),
landed as (select *, case (store_id + length(store_url)) % 5 when 0 then 304 when 1 then 500 when 2 then null else 200 end as http_status from wanted),
seen as (select store_id, store_url, raw_variant, price + 1 as price, case when stock_status = 'agotado' then 'disponible' else 'agotado' end as stock_status from known where coalesce(raw_variant, '') <> 'V3'),
states as (select h.store_id, h.store_url, h.raw_variant, s.price, s.stock_status from hot h join landed l on l.store_id = h.store_id and l.store_url = h.store_url and l.http_status = 200 join seen s on s.store_id = h.store_id and s.store_url = h.store_url and s.raw_variant is not distinct from h.raw_variant)
"""


def _hot(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hot listings, their pages, what landed, and the new states: four products are variants of one page."""
    n = F.col("product_id")
    listings = d.store_product.withColumns({"store_url": F.concat(F.lit("u/"), F.floor(n / 4)), "raw_variant": F.when(n % 4 > 0, F.concat(F.lit("V"), n % 4)), "store_sku": F.when((F.col("store_id") + n) % 9 > 0, F.concat(F.lit("S"), n))})
    products = d.product.withColumn("hot_until", F.when(n % 3 == 1, F.lit(dt.date(1998, 6, 14))).when(n % 3 == 2, F.lit(_TODAY)))
    hot = refresh.hot_listings(listings, d.store, products, _TODAY)
    pages = refresh.pages(hot)
    k = (F.col("store_id") + F.length("store_url")) % 5
    landed = pages.withColumn("http_status", F.when(k == 0, 304).when(k == 1, 500).when(k > 2, 200))
    landed = landed.withColumn("status", refresh.status_of(F.col("http_status"), F.lit(True)))
    other = F.when(F.col("stock_status") == "agotado", "disponible").otherwise("agotado")
    seen = listings.filter(F.coalesce("raw_variant", F.lit("")) != "V3").select("store_id", "store_url", F.col("raw_variant").alias("variant"), (F.col("price") + 1).alias("price"), other.alias("stock_status"), F.lit(0).alias("place"))
    return hot, pages, landed, refresh.new_states(hot, seen.join(landed.filter("status = 'modified'"), ["store_id", "store_url"], "left_semi"))


@query(_HOT + "select store_id, store_url, raw_variant, cast(price as double) as price, stock_status from states")
def hot_refresh(d: Domain) -> DataFrame:
    return _hot(d)[3].select("store_id", "store_url", "raw_variant", F.col("price").cast("double").alias("price"), "stock_status")


@query(_HOT + """, done as (select case when l.store_id % 11 = 0 then 'error' when http_status = 304 then 'not_modified' when http_status = 200 and exists (select 1 from states s where s.store_id = l.store_id and s.store_url = l.store_url) then 'modified' else 'error' end as status from landed l)
select count(*) filter (where status = 'modified') as modified, count(*) filter (where status = 'not_modified') as not_modified, count(*) filter (where status = 'error') as error, count(*) filter (where status = 'not_supported') as not_supported from done""")
def hot_refresh_counts(d: Domain) -> DataFrame:
    _, pages, landed, states = _hot(d)
    return refresh.outcome_counts(refresh.outcomes(pages, landed, states, d.store.filter("store_id % 11 <> 0")))


@query("""select p_partkey as store_id, case when p_size % 5 = 0 then 'not_supported' when p_size % 5 = 1 then 'not_modified' when p_size % 5 = 2 then 'error' when p_size % 7 = 0 then 'error' else 'modified' end as status,
  case when p_size % 5 > 2 and p_size % 7 > 0 then cast(p_size as double) end as price, case when p_size % 5 > 2 and p_size % 7 > 0 then 'disponible' end as stock_status from part""")
def item_refresh(d: Domain) -> DataFrame:
    k = F.col("p_size") % 5
    body = F.when(F.col("p_size") % 7 == 0, "<html>busy</html>").otherwise(F.format_string('{"id":%d,"name":"%s","prices":{"price":"%d","currency_minor_unit":2},"stock_status":"instock"}', "p_partkey", "p_name", (F.col("p_size") * 100).cast("long")))
    landed = d.raw("part").select(F.col("p_partkey").alias("store_id"), F.lit("u").alias("store_url"), F.when(k > 0, F.lit("s")).alias("store_sku"), F.when(k == 1, 304).when(k == 2, 404).otherwise(200).alias("http_status"), body.alias("payload"))
    return refresh.woocommerce_items(landed).select("store_id", "status", "price", "stock_status")


_MOTIVE = """case when product_id is null then 'sin_candidato_en_la_categoria' when exact_name then 'nombre_exacto (debería estar confirmed -- revisar)' when not coalesce(scm, true) then 'set_code_no_coincide'
  when one and not is_fallback and (not lk or lm) then 'categoria_unico_sku (debería estar confirmed -- revisar)' when scm is null and score < 0.35 then 'sin_set_code_similarity_baja_' || printf('%.2f', score)
  when scm is null and score > 0.6 and lm then 'sin_set_code_deberia_confirmar (revisar)' when scm is null then 'sin_set_code_similarity_media_' || printf('%.2f', score)
  when is_fallback then 'candidato_solo_por_fallback_cross_categoria' when not lk then 'idioma_no_detectado_en_raw_name'
  when not lm then 'idioma_no_coincide(clasificado=' || cls_language || ',candidato=' || coalesce(p_language, 'None') || ')'
  when not pm then 'packaging_no_coincide(clasificado=' || cls_packaging || ',candidato=' || coalesce(p_packaging, 'None') || ')' when qa then 'cantidad_ambigua' else 'motivo_desconocido (revisar decide())' end"""


@query(_DECIDED + f"""select l.store_id * 1000000 + l.listed_id as store_product_id, store_name as tienda, l.raw_name, '' as raw_variant, 'tag' as raw_tags, l.listed_id / 100 as precio, l.match_status, split_part(l.category_slug, '/', 1) as product_type,
  coalesce(l.cls_set_code, '') as set_code, coalesce(l.cls_language, '') as language, coalesce(l.cls_packaging, '') as packaging, coalesce(l.category_slug, '') as category_slug, product_id as candidato_id, coalesce(name_canonical, '') as candidato_nombre,
  coalesce(p_set_code, '') as candidato_set_code, coalesce(p_language, '') as candidato_language, coalesce(p_packaging, '') as candidato_packaging, coalesce(printf('%.4f', round(score, 4)), '') as similarity_score, coalesce(is_fallback, false) as es_fallback, {_MOTIVE} as motivo
from listing l join store using (store_id) left join (select * exclude (raw_name, category_slug, cls_set_code, cls_language, cls_packaging, match_status) from decided) c on c.store_id = l.store_id and c.listed_id = l.listed_id where l.match_status in ('needs_review', 'unmatched')""")
def review_report(d: Domain) -> DataFrame:
    listings = d.listing.withColumns({"listing_id": F.col("store_id") * 1_000_000 + F.col("listed_id"), "raw_variant": F.lit(None).cast("string"), "raw_tags": F.lit("tag"), "price": F.col("listed_id") / 100, "product_type": F.split_part("category_slug", F.lit("/"), F.lit(1))})
    return changes.review_report(listings, _evidence(d).filter("rank = 1"), d.store, _KEY, matching.motive())


@query("""select store_id, listed_id from listing where listed_id % 4 = 0 or listed_id % 30 > 14""")
def review_not_hidden(d: Domain) -> DataFrame:
    now = dt.datetime(1998, 6, 15)
    reviewed = F.when(F.col("listed_id") % 4 != 0, F.lit(now) - F.make_dt_interval((F.col("listed_id") % 30).cast("int")))
    return changes.not_hidden(d.listing.withColumn("reviewed_at", reviewed), now).select(*_KEY)


_RESTOCKED = """, turns as (select *, lag(stock_status) over (partition by listing_id order by ts, event_id) as before from signal),
ev as (select event_id, listing_id, listing_id * 13 % (select count(*) from part) + 1 as product_id, listing_id % (select count(*) from supplier) + 1 as store_id from turns where before = 'agotado' and stock_status = 'disponible'),
told as (select event_id, subscriber_id from ev e join product using (product_id) join subscription s on e.product_id = s.product_id and (s.store_id is null or s.store_id = e.store_id))
"""


@query(_RESTOCKED + "select event_id, count(subscriber_id) filter (where subscriber_id % 5 > 1) as sent, count(subscriber_id) filter (where subscriber_id % 5 = 0) as dead from ev left join told using (event_id) group by 1")
def notification_counts(d: Domain) -> DataFrame:
    from pricetide.operators.stock import transitions

    n, m = d.raw("part").count(), d.raw("supplier").count()
    events = transitions(d.signal).select("event_id", "listing_id", (F.col("listing_id") * 13 % n + 1).alias("product_id"))
    listings = events.select("listing_id").distinct().withColumn("store_id", F.col("listing_id") % m + 1)
    told = changes.notifications(events, listings, d.product, d.subscription)
    outcome = F.when(F.col("subscriber_id") % 5 == 0, "dead").when(F.col("subscriber_id") % 5 == 1, "failed").otherwise("sent")
    return changes.notification_counts(events, told.withColumn("outcome", outcome))


@query("""select p_partkey as id, (select coalesce(string_agg(c.p_name, ',' order by c.p_name, c.p_partkey), '') from part c where c.p_partkey % 10 > 1 and c.p_partkey // 10 * 10 = p.p_partkey) as children from part p where p_partkey % 10 = 0""")
def category_nodes(d: Domain) -> DataFrame:
    n = F.col("p_partkey")
    parent = F.when(n % 10 == 1, -1).when(n % 10 > 1, F.floor(n / 10) * 10)
    nodes = catalog.category_nodes(d.raw("part").select(n.alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("c"), n).alias("slug"), parent.alias("parent_id")))
    return nodes.select("id", F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))


@query("select o_orderkey as run_id, case when o_custkey % 7 > 0 and o_custkey % 13 > 0 then s_suppkey end as store_id from orders left join supplier on s_suppkey = o_custkey % 40 + 1")
def store_lookup(d: Domain) -> DataFrame:
    """Runs that name their store by a label; some labels, and some addresses, are unknown."""
    c = F.col("o_custkey")
    runs = d.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.when(c % 7 == 0, "nobody").when(c % 13 == 0, "moved").otherwise(F.concat(F.lit("label "), c % 40 + 1)).alias("label"))
    labels = d.store.select(F.concat(F.lit("label "), "store_id").alias("label"), "website_url")
    moved = labels.limit(1).select(F.lit("moved").alias("label"), F.lit("https://gone.example").alias("website_url"))
    return changes.locate_stores(runs, labels.unionByName(moved), d.store).select("run_id", "store_id")


@query("""select product_id as request, case when product_id % 3 = 0 then 409 when row_number() over (partition by game_slug, product_id // 6, product_id % 3 order by product_id) > 1 then 409 else 201 end as code from product""")
def product_creation(d: Domain) -> DataFrame:
    """Every third request repeats a product's name, pairs of the others ask for the same new one."""
    n = F.col("product_id")
    name = F.when(n % 3 == 0, F.col("name_canonical")).otherwise(F.concat(F.lit("new "), F.floor(n / 6), F.lit(" "), n % 3))
    wanted = d.product.select(n.alias("request"), "game_slug", name.alias("name_canonical"))
    return changes.create_products(d.product, wanted, ["game_slug", "name_canonical"]).select("request", "code")


@query("select store_id, case when store_id % 3 = 0 then null when store_id % 3 = 1 then store_name || ' 2' else store_name end as store_name, case when store_id % 3 = 1 then false else active end as active from store")
def store_patches(d: Domain) -> DataFrame:
    k = F.col("store_id") % 3
    fields = F.when(k == 0, F.array(F.lit("store_name"))).when(k == 1, F.array(F.lit("store_name"), F.lit("active"))).otherwise(F.array().cast("array<string>"))
    patches = d.store.select("store_id", F.when(k == 1, F.concat("store_name", F.lit(" 2"))).alias("store_name"), F.lit(False).alias("active"), fields.alias("fields"))
    return changes.patch_rows(d.store, patches, "store_id")[0].select("store_id", "store_name", "active")


@query("""select p_partkey as id, p_name as name, case p_partkey % 7 when 5 then cast(p_size as double) when 6 then null else cast(p_size as double) + 0.5 end as price,
  case p_partkey % 7 when 0 then 'disponible' when 1 then 'agotado' when 2 then 'disponible' when 3 then 'agotado' when 4 then 'disponible' when 5 then 'agotado' else 'desconocido' end as stock_status, case when p_partkey % 7 = 2 then 'G' || p_partkey end as sku from part""")
def json_ld_shapes(d: Domain) -> DataFrame:
    """Product pages as shops write them: lists, nested and aggregate offers, availability beside the data."""
    k, n, size = F.col("p_partkey") % 7, F.col("p_partkey"), F.col("p_size")
    page = lambda offers, more="", beside="", kind="Product": F.concat(F.lit(f'<html><script type="application/ld+json">[{{"@type":"Organization","name":"shop"}},{{"@type":"{kind}","name":"'), F.col("p_name"), F.lit('"'), F.lit(more) if isinstance(more, str) else more, F.lit(',"offers":'), offers, F.lit("}]</script>" + beside + "</html>"))
    price = F.concat(F.lit('"price":"'), size, F.lit(',50 €"'))
    html = (
        F.when(k == 0, page(F.concat(F.lit("{"), price, F.lit(',"availability":"https://schema.org/BackOrder"}'))))
        .when(k == 1, page(F.concat(F.lit("[{"), price, F.lit(',"availability":"Discontinued"}]')), kind="product"))
        .when(k == 2, page(F.concat(F.lit('{"offers":[{'), price, F.lit(',"availability":"http://schema.org/InStock"}]}')), F.concat(F.lit(',"gtin":"G'), n, F.lit('"'))))
        .when(k == 3, page(F.concat(F.lit("{"), price, F.lit(',"offers":{"price":"1","availability":"OutOfStock"}}'))))
        .when(k == 4, page(F.concat(F.lit("{"), price, F.lit("}")), beside='<span class="label availability"> InStock </span>'))
        .when(k == 5, page(F.concat(F.lit('{"lowPrice":'), size, F.lit("}")), beside='<meta property="product:availability" content="Out of stock">'))
        .otherwise(page(F.lit("{}")))
    )
    return payloads.json_ld(d.raw("part").select(n.alias("id"), html.alias("html"))).select("id", "name", "price", "stock_status", "sku")


@query("""select p_partkey as id, p_name as name, cast(p_size as double) + 0.5 as price, case when p_partkey % 2 = 0 then 'desconocido' when p_partkey % 3 = 0 then 'agotado' when p_partkey % 3 = 1 then 'disponible' when p_partkey % 5 = 0 then 'disponible' else 'desconocido' end as stock_status from part where p_partkey % 17 > 0""")
def detail_rows(d: Domain) -> DataFrame:
    """Product pages of two platforms: one with microdata, one with a reduced price; some have no price."""
    n, size = F.col("p_partkey"), F.col("p_size")
    seen = F.when(n % 3 == 0, '<link itemprop="availability" href="https://schema.org/OutOfStock">').when(n % 3 == 1, '<link itemprop="availability" href="https://schema.org/PreOrder">').when(n % 5 == 0, '<i class="x product-available"></i>').otherwise("")
    micro = F.concat(F.lit("<h1 class='t'> "), F.col("p_name"), F.lit('</h1><meta itemprop="priceCurrency" content="EUR">'), F.when(n % 17 > 0, F.concat(F.lit('<span itemprop="price" content="'), size, F.lit('.5">x</span>'))).otherwise(""), seen)
    plain = F.concat(F.lit("<h1>Clic para ampliar "), F.col("p_name"), F.lit("</h1>opciones disponibles"), F.when(n % 17 > 0, F.concat(F.lit('<ul class="list price"><li>99,00€</li><li>'), size, F.lit(",50€</li></ul>"))).otherwise(""))
    part = d.raw("part")
    a = payloads.prestashop_detail(part.filter(n % 2 == 1).select(n.alias("id"), micro.alias("html")))
    return a.unionByName(payloads.opencart_detail(part.filter(n % 2 == 0).select(n.alias("id"), plain.alias("html"))))


@query("select p_partkey as id, case p_partkey % 5 when 0 then p_name || ' whole' when 1 then p_name || ' … more' when 2 then p_name || '...' when 3 then p_name || ' whole' else p_name end as name from part")
def resolved_names(d: Domain) -> DataFrame:
    n, k = F.col("p_partkey"), F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, "…").when(k == 1, " … more").when((k == 2) | (k == 3), "...").otherwise(""))
    rows = d.raw("part").select(n.alias("id"), name.alias("name"), F.concat(F.lit("u/"), n).alias("url"))
    pages = d.raw("part").filter(k != 2).select(F.concat(F.lit("u/"), n).alias("url"), F.concat(F.lit('<p>x</p><h1 class="product_title entry-title">'), F.col("p_name"), F.lit(" whole</h1>")).alias("html"))
    return payloads.resolve_truncated(rows, pages).select("id", "name")


@query("""select p_type as slug, p_partkey as id, p_name as name, cast(round(p_retailprice * 100) as bigint) / 100.0::double as price from part where p_name like '%a%' and p_size % 2 = 0""")
def woocommerce_scopes(d: Domain) -> DataFrame:
    """API pages of every category, in scope by a word of the name; half of the items are of other categories."""
    slug = F.when(F.col("p_size") % 2 == 0, "boxes").otherwise("figures")
    payload = F.format_string('[{"id":%d,"name":"%s","permalink":"u","categories":[{"slug":"x"},{"slug":"%s"}],"prices":{"price":"%d","currency_minor_unit":2},"is_in_stock":true,"images":[]}]', "p_partkey", "p_name", slug, F.round(F.col("p_retailprice") * 100).cast("long"))
    rows = payloads.woocommerce(d.raw("part").select(F.col("p_type").alias("slug"), payload.alias("payload")), "Boxes", ("a",))
    return rows.select("slug", F.col("id_product").cast("long").alias("id"), "name", "price")


@query(""", last as (select max(scraped_date) as d from price_history), old as (select store_id, product_id, price, stock_status, match_status from price_history, last where scraped_date <= d - 365 qualify row_number() over (partition by store_id, product_id order by scraped_date desc, l_orderkey desc, l_linenumber desc) = 1),
new as (select store_id, product_id, price, stock_status from price_history, last where scraped_date > d - 365 qualify row_number() over (partition by store_id, product_id order by scraped_date desc, l_orderkey desc, l_linenumber desc) = 1)
select store_id, product_id, cast(case when n.store_id is null then o.price else n.price end as double) as price, coalesce(n.stock_status, o.stock_status) as stock_status, coalesce(o.match_status, 'needs_review') as match_status from old o full join new n using (store_id, product_id)""")
def snapshot_merge_latest(d: Domain) -> DataFrame:
    """The last year's observations over the snapshot of before."""
    last = d.price_history.agg(F.max("scraped_date")).first()[0] - dt.timedelta(days=365)
    newest = lambda df: df.groupBy("store_id", "product_id").agg(F.max_by(F.struct("price", "stock_status", "match_status"), F.struct("scraped_date", "seq")).alias("r")).select("store_id", "product_id", "r.*")
    old = newest(d.price_history.filter(F.col("scraped_date") <= F.lit(last)))
    new = newest(d.price_history.filter(F.col("scraped_date") > F.lit(last))).withColumn("match_status", F.lit("needs_review"))
    return ingest.merge_snapshot(old, new, ["store_id", "product_id"], ["price", "stock_status"]).withColumn("price", F.col("price").cast("double"))


#: Leads of listing names with the table their titles come from, and what a reader makes of them: type, whether packaged.
_LEADS = [
    ("Starter Deck ", tables.STARTER_DECK_TITLES + tables.STARTER_DECK_CHARACTERS, "STARTER_DECK", True),
    ("Double Pack ", tables.DOUBLE_PACK_TITLES, "DOUBLE_PACK", True),
    ("Un sobre de ", tables.BOOSTER_TITLES, "ONE_PIECE", True),
    ("Funda ", tables.SLEEVES_VARIANTS, "SLEEVES", False),
    ("Boosters [OP-01]-[OP-13] ", [("", None)], "ONE_PIECE", True),  # a range is no single product
    ("Articulo ", [("", None)], "ONE_PIECE", True),  # sealed by its tags only
]


def _leads(value) -> str:
    return "case p_partkey % 6 " + " ".join(f"when {k} then {value(k, row)}" for k, row in enumerate(_LEADS)) + " end"


def _titles(rows: list[tuple[str, str]]) -> str:
    return "[" + ", ".join(f"'{part}'" for part, _ in rows) + "]"


@query(f""", title(lead, place, needle, code) as (values {", ".join(f"({k}, {i}, '{part}', '{code}')" for k, row in enumerate(_LEADS) for i, (part, code) in enumerate(row[1]) if code)}),
main(dp, op) as (values {", ".join(f"('{dp}', '{op}')" for dp, op in tables.BOOSTER_OF_DOUBLE_PACK.items())}),
c as (select p_partkey as id, p_partkey % 6 as lead, p_size, {_leads(lambda k, row: f"'{row[2]}'")} as product_type, {_leads(lambda k, row: str(row[3]).lower())} as packed,
  lower({_leads(lambda k, row: f"'{row[0]}' || {_titles(row[1])}[1 + p_partkey // 6 % {len(row[1])}]")} || ' ' || p_brand || ' ref ' || p_partkey) as name from part),
n as (select *, trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) as norm from c),
coded as (select id, arg_min(code, place) as set_code from n join title using (lead) where contains(norm, needle) group by id)
select id, product_type, set_code, case when p_size % 4 = 2 then 'JP' else 'EN' end as language, case lead when 1 then op when 2 then set_code end as main_set,
  case when packed then case when p_size % 4 = 3 then 'display' else 'sobre' end end as packaging, replace(lower(product_type), '_', '-') as category_slug
from n left join coded using (id) left join main on dp = set_code""")
def classified_titles(d: Domain) -> DataFrame:
    """Names with titles of the tables (blanks as entities in half of them), variants, a range, and names that only their tags explain."""
    n = F.col("p_partkey")
    name = F.coalesce(*(F.when(n % 6 == k, F.concat(F.lit(lead), F.get(F.array(*(F.lit(part) for part, _ in rows)), F.floor(n / 6).cast("int") % len(rows)))) for k, (lead, rows, _, _) in enumerate(_LEADS)))
    # the last blank of a title as a sign
    name = F.when((F.col("p_size") % 2 == 0) & (n % 6 != 4), F.regexp_replace(name, "(?<=[a-z]) (?=[a-z0-9]+$)", " &#8211; ")).otherwise(name)
    variant = F.when(F.col("p_size") % 4 == 1, "Inglés").when(F.col("p_size") % 4 == 2, "Japonés").when(F.col("p_size") % 4 == 3, "Caja")
    named = F.concat(name, F.lit(" "), F.col("p_brand"), F.lit(" ref "), n)
    rows = classify(d.raw("part").select(n.alias("id"), named.alias("name"), variant.alias("variant"), F.when(n % 6 == 5, "booster, OP-05").alias("tags")))
    return rows.select("id", "cls.*", category_of(F.col("cls.product_type")).alias("category_slug"))
