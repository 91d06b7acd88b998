"""Registered queries over refreshed pages, classified scrapes, run logs and small reads, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.catalog_queries import _EVENTS, _events, query
from pricetide.functions.titles import with_titles
from pricetide.operators import catalog, ingest, refresh, runs, stock
from pricetide.plans.adapters import Domain
from pricetide.sources import landed, payloads
from pricetide.sources.storage import shared_folder


@query("""select p_partkey as store_id, v as place, 'V' || v as variant, p_name as name, cast(p_size + v as double) + 0.5 as price, case when (p_size + v) % 2 = 0 then 'disponible' else 'agotado' end as stock_status, 'modified' as status from part, range(3) t(v) where p_size % 5 > 2
union all select p_partkey, null, null, null, null, null, case when p_size % 5 = 1 then 'not_modified' else 'error' end from part where p_size % 5 <= 2""")
def shopify_item_refresh(d: Domain) -> DataFrame:
    """Item pages with three variants each; some are no JSON, some without variants, some unchanged."""
    k = F.col("p_size") % 5
    variants = F.concat_ws(",", *(F.format_string('{"title":"V%d","price":"%d.50","available":%s}', F.lit(v), (F.col("p_size") + v).cast("int"), ((F.col("p_size") + v) % 2 == 0).cast("string")) for v in range(3)))
    body = F.when((k == 0) & (F.col("p_partkey") % 2 == 0), "<html>busy").when(k == 0, '{"product":{"title":"x","variants":[]}}').otherwise(F.concat(F.lit('{"product":{"title":"'), "p_name", F.lit('","variants":['), variants, F.lit("]}}")))
    landed = d.raw("part").select(F.col("p_partkey").alias("store_id"), F.lit("u").alias("store_url"), F.when(k == 1, 304).when(k == 2, F.when(F.col("p_partkey") % 2 == 0, 500)).otherwise(200).alias("http_status"), body.alias("payload"))
    return refresh.shopify_items(landed).select("store_id", F.col("place").cast("long").alias("place"), "variant", "name", "price", "stock_status", "status")


@query("""select p_partkey as store_id, case p_size % 6 when 0 then 'not_modified' when 1 then 'error' when 2 then 'error' else 'modified' end as status, case when p_size % 6 > 2 then p_name end as name, case when p_size % 6 > 2 then cast(p_size as double) + 0.25 end as price,
  case when p_size % 6 > 2 then case p_partkey % 4 when 0 then 'disponible' when 1 then 'desconocido' when 2 then 'agotado' else 'desconocido' end end as stock_status from part""")
def page_refresh(d: Domain) -> DataFrame:
    """Product pages of four platforms, unchanged, missing, without a product, and good ones."""
    k, name, price = F.col("p_size") % 6, F.col("p_name"), F.concat(F.col("p_size"), F.lit(",25"))
    ld = lambda kind: F.concat(F.lit(f'<script type="application/ld+json">{{"@type":"{kind}","name":"'), name, F.lit('","offers":{"price":"'), price, F.lit('"}}</script>'))
    bodies = {
        "odoo": ld("Product"),
        "jsonld": ld("product"),
        "prestashop": F.concat(F.lit("<h1>"), name, F.lit('</h1><span itemprop="price" content="'), price, F.lit('">x</span><link itemprop="availability" href="https://schema.org/OutOfStock">')),
        "opencart": F.concat(F.lit("<h1>Clic para ampliar "), name, F.lit('</h1><p class="price">99,00 € '), price, F.lit(" €</p>")),
    }
    status = F.when(k == 0, 304).when(k == 1, F.when(F.col("p_partkey") % 2 == 0, 404)).otherwise(200)
    out = None
    for place, (platform, body) in enumerate(bodies.items()):
        html = F.when(k == 2, "<html><h1>gone</h1></html>").otherwise(body)
        landed = d.raw("part").filter(F.col("p_partkey") % 4 == place).select(F.col("p_partkey").alias("store_id"), F.lit("u").alias("store_url"), status.alias("http_status"), html.alias("html"))
        rows = refresh.page_items(landed, platform).select("store_id", "status", "name", "price", "stock_status")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""select s_suppkey as store_id, 'https://shop' || s_suppkey || '/products/h' || p_partkey as store_url, cast(null as varchar) as raw_variant, 'Booster Box OP-' || printf('%02d', p_size % 17 + 1) || ' ' || p_name as raw_name, 'tag' as raw_tags,
  'ONE_PIECE' as product_type, printf('OP%02d', p_size % 17 + 1) as set_code, 'EN' as language, cast(p_size as double) as price from part join supplier on s_suppkey = p_partkey % 40 + 1 where p_partkey % 6 > 0""")
def scraped_rows(d: Domain) -> DataFrame:
    """Parser rows with their classes and their stores; nameless ones are dropped by the check."""
    n, store = F.col("p_partkey"), F.col("p_partkey") % 40 + 1
    name = F.when(n % 6 > 0, F.format_string('"Booster Box OP-%02d %s"', (F.col("p_size") % 17 + 1).cast("int"), F.col("p_name"))).otherwise("null")
    payload = F.concat(F.lit('{"products":[{"id":'), n, F.lit(',"title":'), name, F.lit(',"handle":"h'), n, F.lit('","tags":"tag","images":[],"variants":[{"price":"'), F.col("p_size"), F.lit('","available":true}]}]}'))
    pages = d.raw("part").select(F.concat(F.lit("https://shop"), store).alias("store_url"), store.alias("number"), payload.alias("payload"))
    parsed = payloads.shopify(pages).join(d.store.select(F.col("store_id").alias("number"), F.col("store_name").alias("store")), "number").withColumn("platform", F.lit("shopify"))
    products = ingest.product_rows(parsed)
    rows = ingest.accepted(ingest.scraped_rows(products, d.store))
    classes = products.select(F.col("url").alias("store_url"), "product_type", "set_code", "language")
    return rows.join(classes, "store_url").select("store_id", "store_url", "raw_variant", "raw_name", "raw_tags", "product_type", "set_code", "language", "price")


@query(_EVENTS + """select event_id, name_canonical, store_name, cast(price as double) as price from ev join product using (product_id) join store using (store_id) join (select store_id, product_id, price from store_product) l using (store_id, product_id)
where game_slug = (select min(game_slug) from product)""")
def restock_feed_of_game(d: Domain) -> DataFrame:
    """The feed of one game with present prices; events of listings that are not there are left out."""
    game = d.product.agg(F.min("game_slug")).first()[0]
    feed = stock.restock_feed(_events(d), d.product, d.store, dt.datetime(2100, 1, 1), 10**6, game=game, listings=d.store_product)
    return feed.select("event_id", "name_canonical", "store_name", F.col("price").cast("double").alias("price"))


_LOG = """, marks as (select o_orderkey // 4 as run_id, o_custkey % 9 as store, o_orderdate as moment, o_orderkey % 4 as k, o_orderkey, o_totalprice from orders)
"""


@query(_LOG + """, begun as (select run_id, moment as started_at from marks where k = 0), ended as (select run_id, max(moment) as finished_at, arg_max(case when o_orderkey % 8 = 3 then 'failed' else 'completed' end, moment) as status from marks where k = 3 group by 1),
stores as (select run_id, store, max({'at': moment, 'n': cast(floor(o_totalprice) as bigint)}).n as n from marks where k in (1, 2) group by 1, 2),
sums as (select run_id, count(*) as stores_done, sum(n) as n from stores group by 1)
select run_id, coalesce(status, 'running') as status, started_at, finished_at, cast(coalesce(stores_done, 0) as bigint) as stores_done, cast(coalesce(n, 0) as bigint) as n from begun left join ended using (run_id) left join sums using (run_id) where finished_at is null or finished_at > started_at""")
def run_states(d: Domain) -> DataFrame:
    """Runs from the rows of their log: a begin, up to two stores and maybe an end, in any order of arrival."""
    k = F.col("o_orderkey") % 4
    log = d.raw("orders").select(
        F.floor(F.col("o_orderkey") / 4).cast("string").alias("run_id"), F.when(k == 0, "daily_sweep").alias("job_type"), F.when(k.isin(1, 2), F.concat(F.lit("s"), F.col("o_custkey") % 9)).alias("store_label"),
        F.when(k == 0, "running").when(k == 3, F.when(F.col("o_orderkey") % 8 == 3, "failed").otherwise("completed")).alias("status"), F.col("o_orderdate").alias("at"), F.lit(9).alias("stores_total"),
        F.when(k.isin(1, 2), F.floor("o_totalprice")).alias("rows"), F.lit(0).cast("long").alias("dropped"), F.lit(0).cast("long").alias("cut"),
    )
    begun = log.filter("status = 'running'").select("run_id", F.col("at").alias("_begun"))
    known = runs.states(log).join(begun, "run_id").filter("finished_at is null or finished_at > _begun")
    return known.select(F.col("run_id").cast("long").alias("run_id"), "status", F.col("_begun").alias("started_at"), "finished_at", "stores_done", F.col("rows").alias("n"))


@query("""select p_partkey as id, row_number() over (order by p_name, p_partkey) as place from part""")
def flat_categories(d: Domain) -> DataFrame:
    nodes = d.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"))
    return catalog.flat_categories(nodes).select("id", F.col("place").cast("long").alias("place"))


@query("""select c_custkey as product_id, name_canonical, case when p.product_id is null then 404 else 200 end as code from customer left join product p on p.product_id = c_custkey""")
def raw_products(d: Domain) -> DataFrame:
    wanted = d.raw("customer").select(F.col("c_custkey").alias("product_id"))
    return catalog.raw_products(d.product, wanted).select("product_id", "name_canonical", "code")


@query("""select store_id, store_name, coalesce(n, 0) as consecutive_failures, row_number() over (order by store_name, store_id) as place from store left join (select s_suppkey as store_id, s_suppkey % 5 as n from supplier where s_suppkey % 3 > 0) h using (store_id)""")
def detailed_stores(d: Domain) -> DataFrame:
    n = F.col("store_id")
    health = d.store.filter("store_id % 3 > 0").select("store_id", F.lit(None).cast("timestamp").alias("last_scraped_at"), (n % 5).alias("consecutive_failures"), F.lit(None).cast("timestamp").alias("backoff_until"))
    rows = catalog.detailed_stores(d.store, health)
    return rows.select("store_id", "store_name", "consecutive_failures", F.col("place").cast("long").alias("place"))


@query("""select 'https://shop ' || p_size as store, p_partkey as id, p_name as name, cast(p_partkey % 90 as double) + 0.5 as price, 'https://shop ' || p_size || '/products/h' as url from part where p_size between 10 and 30""")
def landed_payloads(d: Domain) -> DataFrame:
    """Payloads as a fetcher leaves them, a folder per store, read back through the source for some of the stores."""
    path = f"{shared_folder(d.spark)}/pricetide-landed-{uuid.uuid4().hex}"
    payload = F.concat(F.lit('{"products":[{"id":'), "p_partkey", F.lit(',"title":"'), "p_name", F.lit('","handle":"h","images":[],"variants":[{"price":"'), F.col("p_partkey") % 90, F.lit(',50","available":true}]}]}'))
    d.raw("part").select(F.concat(F.lit("https://shop "), "p_size").alias("store"), payload.alias("value")).repartition("store").write.partitionBy("store").text(path)
    rows = landed.scraped(d.spark, path, "shopify", [f"https://shop {k}" for k in range(10, 31)], lines=True)
    return rows.select("store", F.col("id_product").cast("long").alias("id"), "name", "price", "url")


@query("""
, lines as (select 'names' as tab, row_number() over (order by p_name) as place, substring(p_name, 1, 9) as title, p_name as code from (select distinct p_name from part) union all
  select 'brands', min(p_partkey), substring(lower(p_brand), 1, 7), p_brand from part group by p_brand),
names as (select distinct store_id, listed_id, lower(raw_name) as name from listing)
select store_id, listed_id, arg_min(code, place) filter (where tab = 'names') as title, arg_min(code, place) filter (where tab = 'brands') as brand from names left join lines on contains(name, title) group by 1, 2""")
def titles_in_names(d: Domain) -> DataFrame:
    """Listing names looked up in two tables made from the catalog; parts of titles stand for several lines."""
    part = d.raw("part")
    names = part.select("p_name").distinct().select(F.lit("names").alias("table"), F.expr("row_number() over (order by p_name)").alias("place"), F.substring("p_name", 1, 9).alias("title"), F.col("p_name").alias("code"))
    brands = part.groupBy("p_brand").agg(F.min("p_partkey").alias("place")).select(F.lit("brands").alias("table"), "place", F.substring(F.lower("p_brand"), 1, 7).alias("title"), F.col("p_brand").alias("code"))
    rows = with_titles(d.listing.withColumn("name", F.lower("raw_name")), "name", names.unionByName(brands))
    return rows.select("store_id", "listed_id", F.col("titles")["names"].alias("title"), F.col("titles")["brands"].alias("brand"))
