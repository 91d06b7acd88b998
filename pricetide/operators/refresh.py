"""Refresh of hot listings: which pages to read again, what came of it, and the new prices and stock.

Pages are landed by whatever fetches them, a row per page with its HTTP status (null: no answer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.sources import payloads
from pricetide.sources.payloads import woocommerce

PAGE = ["store_id", "website_url", "store_url"]
OUTCOMES = ["modified", "not_modified", "error", "not_supported"]


def still_hot(products: DataFrame, today) -> DataFrame:
    """Hot products without an end date, or whose last day is not over."""
    return products.filter(F.col("is_hot") & F.coalesce(F.col("hot_until") >= F.lit(today), F.lit(True)))


def hot_listings(listings: DataFrame, stores: DataFrame, products: DataFrame, today) -> DataFrame:
    """Known listings of hot products with their store's address; new ones are never found here."""
    hot = still_hot(products, today).select("product_id")
    return listings.join(hot, "product_id", "left_semi").join(stores.select("store_id", "website_url"), "store_id")


def pages(hot: DataFrame) -> DataFrame:
    """One row per page: the number of its listings, and the SKU of the first (by variant, none first)."""
    first = F.min_by("store_sku", F.struct(F.coalesce("raw_variant", F.lit("")), F.coalesce("store_sku", F.lit(""))))
    return hot.groupBy(*PAGE).agg(F.count("*").alias("n_listings"), first.alias("store_sku"))


def status_of(http_status: Column, readable: Column, supported: Column | None = None) -> Column:
    """What became of a page: ``readable`` says that the parser found a product in it."""
    asked = F.lit(True) if supported is None else F.coalesce(supported, F.lit(False))
    good = (http_status == 200) & F.coalesce(readable, F.lit(False))
    return F.when(~asked, "not_supported").when(http_status == 304, "not_modified").when(good, "modified").otherwise("error")


def woocommerce_items(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per page of the item endpoint with ``status``, and price and stock if it was read; rows
    without a SKU have no such endpoint and are not supported."""
    keys = [c for c in landed.columns if c != payload]
    item = F.when(F.ltrim(payload).startswith("{"), F.concat(F.lit("["), payload, F.lit("]")))
    read = woocommerce(landed.filter("http_status = 200").withColumn(payload, item), payload=payload).filter("id_product is not null")
    found = read.select("store_id", "store_url", F.lit(None).cast("string").alias("variant"), "price", "stock_status", F.lit(True).alias("_read"))
    joined = landed.select(keys).join(found, ["store_id", "store_url"], "left")
    joined = joined.withColumn("status", status_of(F.col("http_status"), F.col("_read"), F.coalesce("store_sku", F.lit("")) != "")).drop("_read")
    return joined.withColumns({c: F.when(F.col("status") == "modified", F.col(c)) for c in ("price", "stock_status")})


#: How each platform's own page of a product is read; the other platforms have endpoints for items.
DETAIL_PAGES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "odoo": lambda df, html: payloads.json_ld(df, html, strict=True),
    "jsonld": payloads.json_ld,
    "prestashop": payloads.prestashop_detail,
    "opencart": payloads.opencart_detail,
}


def page_items(landed: DataFrame, platform: str, html: str = "html") -> DataFrame:
    """One row per landed product page of a platform of ``DETAIL_PAGES`` with ``status``, and name, price and stock
    if a product was found in it.  These pages know no variants."""
    keys = [c for c in landed.columns if c != html]
    read = DETAIL_PAGES[platform](landed.filter("http_status = 200").select("store_id", "store_url", html), html)
    found = read.select("store_id", "store_url", "name", "price", "stock_status", F.lit(True).alias("_read"))
    joined = landed.select(keys).join(found, ["store_id", "store_url"], "left").withColumn("variant", F.lit(None).cast("string"))
    return joined.withColumn("status", status_of(F.col("http_status"), F.col("_read"))).drop("_read")


def shopify_items(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per variant of landed item pages, and one for a page without any, with ``status``; ``place``
    is the variant's in the page."""
    keys = [c for c in landed.columns if c != payload]
    read = payloads.shopify_item(landed.filter("http_status = 200").select("store_id", "store_url", payload), payload).withColumn("_read", F.lit(True))
    joined = landed.select(keys).join(read, ["store_id", "store_url"], "left")
    return joined.withColumn("status", status_of(F.col("http_status"), F.col("_read"))).drop("_read")


def new_states(hot: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The listings of refreshed pages with the price and stock of the variant of their name (no name is a
    name).  Of variants that come twice the first counts (``place``); listings without one are left out."""
    order = Window.partitionBy("store_id", "store_url", "variant").orderBy("place")
    one = refreshed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").alias("r")
    h = hot.drop("price", "stock_status").alias("h")
    same = [F.col(f"h.{c}") == F.col(f"r.{c}") for c in ("store_id", "store_url")] + [F.col("h.raw_variant").eqNullSafe(F.col("r.variant"))]
    return h.join(one, same).select("h.*", "r.price", "r.stock_status")


def outcomes(wanted: DataFrame, landed: DataFrame, states: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` pages with their ``status``: error for stores that nobody knows (``known``: website_url),
    for pages that did not land, and for pages none of whose variants is a known listing."""
    hit = states.select("store_id", "store_url").distinct().withColumn("_hit", F.lit(True))
    d = wanted.join(landed.select("store_id", "store_url", F.col("status").alias("_s")), ["store_id", "store_url"], "left")
    d = d.join(hit, ["store_id", "store_url"], "left").join(known.select("website_url").distinct().withColumn("_known", F.lit(True)), "website_url", "left")
    bad = F.col("_known").isNull() | F.col("_s").isNull() | ((F.col("_s") == "modified") & F.col("_hit").isNull())
    return d.withColumn("status", F.when(bad, "error").otherwise(F.col("_s"))).select(*wanted.columns, "status")


def outcome_counts(done: DataFrame) -> DataFrame:
    """One row: how many pages had each outcome."""
    return done.agg(*(F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES))
