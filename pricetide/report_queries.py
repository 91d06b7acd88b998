"""Registered queries over sinks, write-backs, logs and less frequent payloads, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.catalog_queries import _DECIDED, _KEY, _rematch, query
from pricetide.functions.classify import classify
from pricetide.functions.times import from_unix, to_unix
from pricetide.operators import changes, ingest, matching, stock
from pricetide.plans.adapters import Domain
from pricetide.sources import payloads, sinks
from pricetide.sources.storage import shared_folder

_NOW = dt.datetime(1998, 6, 15, 12)


def _path(d: Domain, name: str) -> str:
    return f"{shared_folder(d.spark)}/pricetide-{name}-{uuid.uuid4().hex}"


@query("""select page_id, 'https://s/' || case when page_id % 3 = 0 then 'sitemap_products_' else 'Product-map-' end || page_id || '.xml' as loc from pages where page_id % 3 < 2""")
def sitemap_index(d: Domain) -> DataFrame:
    """Of an index only the sub-maps for products."""
    n = F.col("page_id")
    name = F.when(n % 3 == 0, "sitemap_products_").when(n % 3 == 1, "Product-map-").otherwise("sitemap_pages_")
    xml = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s/'), name, n, F.lit(".xml</loc></sitemap><sitemap><loc>https://s/collections.xml</loc></sitemap></sitemapindex>"))
    return payloads.sitemap(d.raw("pages").select("page_id", xml.alias("xml")), only_products=True)


@query("""select p_name || ' ' || p_partkey as name, case when p_size % 3 > 0 then 'OP-' || p_size end as code from part""")
def official_catalog(d: Domain) -> DataFrame:
    one = F.to_json(F.struct(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("OP-"), "p_size")).alias("code")))
    payload = d.raw("part").groupBy("p_size").agg(F.concat(F.lit('{"products":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("payload"))
    return payloads.official_catalog(payload.select("payload"))


@query("""select s_suppkey as store_id, 'api' as name from supplier where s_suppkey % 3 > 0 union all select s_suppkey, 'html' from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 = 0""")
def api_or_html(d: Domain) -> DataFrame:
    """API rows of shops whose API answers, cards of list pages for the others that have such."""
    s = d.raw("supplier").withColumnRenamed("s_suppkey", "store_id")
    body = F.when(F.col("store_id") % 3 > 0, '[{"id":1,"name":"api","prices":{"price":"100"}}]').otherwise("[]")
    api = payloads.woocommerce(s.select("store_id", body.alias("payload")))
    html = payloads.html_cards(s.filter("store_id % 2 = 0").select("store_id", F.lit("<li class=product><h2>html</h2></li>").alias("html")), "woocommerce")
    return payloads.api_or_html(api, html).select("store_id", "name")


@query("""select store_id, product_id, cast(price as double) as price, case when product_id % 3 = 0 then timestamp '1998-06-15 12:00:00' else timestamp '1998-01-01 00:00:00' end as last_checked_at from store_product""")
def touched(d: Domain) -> DataFrame:
    """Listings that did not change: nothing but the time of the check moves."""
    old = d.store_product.select("store_id", "product_id", F.col("price").cast("double").alias("price"), F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz").alias("last_checked_at"))
    seen = old.filter("product_id % 3 = 0")
    return ingest.touch(old, seen.unionAll(seen), ["store_id", "product_id"], "last_checked_at", _NOW).select("store_id", "product_id", "price", F.col("last_checked_at").cast("timestamp_ntz").alias("last_checked_at"))


@query("""select store_id from store where active and store_id % 4 <> 0""")
def runnable_stores(d: Domain) -> DataFrame:
    n = F.col("store_id")
    paused = F.when(n % 4 == 0, F.lit(_NOW + dt.timedelta(minutes=1))).when(n % 4 == 1, F.lit(_NOW))
    return stock.runnable(d.store.withColumn("backoff_until", paused), _NOW).select("store_id")


@query("""select event_id, cast(epoch_us(ts) as double) / 1000000 as seconds, case when event_id % 2 = 0 then ts end as back from events""")
def unix_times(d: Domain) -> DataFrame:
    seconds = to_unix(F.col("ts").cast("timestamp"))
    rows = d.raw("events").select("event_id", seconds.alias("seconds"))
    return rows.withColumn("back", from_unix(F.when(F.col("event_id") % 2 == 0, F.col("seconds"))).cast("timestamp_ntz"))


@query("""select l_orderkey as run, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as line, case when l_linenumber % 3 > 0 then l_partkey end as page, case when l_linenumber % 3 = 1 then l_suppkey end as total
from lineitem qualify row_number() over (partition by l_orderkey order by l_partkey * 100000 + l_suppkey * 10 + l_linenumber desc) <= 2""")
def log_progress(d: Domain) -> DataFrame:
    """The last two lines of each run's log and the progress they state."""
    k = F.col("l_linenumber") % 3
    message = F.when(k == 1, F.concat(F.lit("solicitando página "), "l_partkey", F.lit("/"), "l_suppkey", F.lit("..."))).when(k == 2, F.concat(F.lit("producto "), "l_partkey", F.lit(": x"))).otherwise("página siguiente")
    lines = d.raw("lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("line"), message.alias("message"))
    p = changes.progress(F.col("message"))
    return changes.log_tail(lines, "run", "line", 2).select("run", "line", p["page"].cast("long").alias("page"), p["total"].cast("long").alias("total"))


@query("""select store_id, product_id, scraped_date, cast(case when scraped_date >= date '1998-06-01' then price + 1 else price end as double) as price from price_history""")
def daily_partitions(d: Domain) -> DataFrame:
    """A history in partitions (of a year here) of which the last is written again; the others stay."""
    path = _path(d, "days")
    history = d.price_history.select("store_id", "product_id", "scraped_date", F.year("scraped_date").alias("year"), F.col("price").cast("double").alias("price"))
    sinks.write_days(history.repartition("year", "store_id"), path, "year")  # a year is no single task
    raised = F.when(F.col("scraped_date") >= "1998-06-01", F.col("price") + 1).otherwise(F.col("price"))
    sinks.write_days(history.filter("year >= 1998").withColumn("price", raised).repartition("year", "store_id"), path, "year")
    sinks.append(history.limit(0), path)
    return d.spark.read.parquet(path).select("store_id", "product_id", "scraped_date", "price")


@query("""select 's' || p_size as "store", 'odoo' as "platform", cast(p_partkey as varchar) as "idProduct", p_name as "name", 'OTROS' as "productType", cast(p_size as double) + 0.5 as "price", cast(null as varchar) as "imageUrl" from part""")
def products_csv(d: Domain) -> DataFrame:
    """The product report as written and read back, under the names that interfaces outside know."""
    part = d.raw("part").select(F.concat(F.lit("s"), "p_size").alias("store"), F.lit("odoo").alias("platform"), F.col("p_partkey").alias("id_product"), F.col("p_name").alias("name"), (F.col("p_size") + 0.5).alias("price"), F.lit("agotado").alias("stock_status"), F.lit('u, "x"').alias("url"))
    path = _path(d, "csv")
    sinks.write_csv(ingest.product_rows(part), path, sinks.PRODUCT_FIELDS)
    rows = d.spark.read.option("header", True).csv(path)
    return sinks.camel(rows.withColumn("price", F.col("price").cast("double"))).select("store", "platform", "idProduct", "name", "productType", "price", "imageUrl")


@query("""select s_name as store, 'odoo' as platform, case when s_suppkey % 2 = 0 then 'timeout' end as reason from supplier""")
def failed_stores_csv(d: Domain) -> DataFrame:
    rows = d.raw("supplier").select(F.col("s_name").alias("store"), F.lit("odoo").alias("platform"), F.when(F.col("s_suppkey") % 2 == 0, "timeout").alias("reason"), "s_suppkey")
    path = _path(d, "csv")
    sinks.write_csv(rows, path, sinks.FAILED_STORE_FIELDS)
    return d.spark.read.option("header", True).csv(path)


@query("""select p_partkey as id, case p_partkey % 4 when 0 then 'ILLUSTRATION_BOX' when 1 then 'PLAYMAT' when 2 then 'PREMIUM_CARD_COLLECTION' else 'DEVIL_FRUITS_COLLECTION' end as product_type,
  case when p_partkey % 4 = 3 then printf('DF%02d', p_size) else printf('VOL%02d', p_size) end as set_code from part""")
def classified_accessories(d: Domain) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.format_string("%02d", F.col("p_size").cast("int"))
    name = F.when(k == 0, F.concat(F.lit("Illustration Box IB-"), size)).when(k == 1, F.concat(F.lit("Tapete oficial vol. "), "p_size")).when(k == 2, F.concat(F.lit("PREMIUM CARD COLLECTION Vol."), size)).otherwise(F.concat(F.lit("Devil Fruits Collection DF-"), size))
    none = F.lit(None).cast("string")
    rows = classify(d.raw("part").select(F.col("p_partkey").alias("id"), name.alias("name"), none.alias("variant"), none.alias("tags")))
    return rows.select("id", "cls.product_type", "cls.set_code")


@query(_DECIDED + """select l.store_id, l.listed_id, case when l.match_status = 'confirmed' then 'confirmed' else coalesce(d.new_status, 'unmatched') end as match_status, case when d.new_status = 'confirmed' then d.product_id end as product_id
from listing l left join (select store_id, listed_id, product_id, new_status from decided) d using (store_id, listed_id)""")
def rematched_listings(d: Domain) -> DataFrame:
    """The listings with the outcome of their match written back; confirmed ones stay."""
    state = d.listing.withColumns({"product_id": F.lit(None).cast("long"), "match_confidence": F.lit(None).cast("double")})
    return matching.rematched_state(state, _rematch(d), _KEY).select(*_KEY, "match_status", "product_id")
