"""Catalog reads: search with price aggregates, listings of a product, daily curves, category tree, deals."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.prices import drop_percent
from pricetide.functions.trigram import similarity, trigrams

PAGE_LIMIT = 100
FUZZY_LEAST = 0.2


@dataclass(frozen=True)
class ProductFilters:
    game_slug: str | None = None
    category_slug: str | None = None
    set_code: str | None = None
    language: str | None = None
    is_hot: bool | None = None
    min_price: Decimal | None = None
    max_price: Decimal | None = None
    text: str | None = None
    page: int = 1
    limit: int = 20


def category_nodes(categories: DataFrame) -> DataFrame:
    """Roots of the category tree (id, name, slug, parent_id) with their children by name; categories whose
    parent does not exist are dropped."""
    child = F.struct("name", "id", "slug")
    children = categories.filter("parent_id is not null").groupBy("parent_id").agg(F.sort_array(F.collect_list(child)).alias("children"))
    roots = categories.filter("parent_id is null").drop("parent_id").join(children, F.col("id") == F.col("parent_id"), "left").drop("parent_id")
    return roots.withColumn("children", F.coalesce("children", F.array().cast(children.schema["children"].dataType)))


def confirmed_aggregates(listings: DataFrame) -> DataFrame:
    """Per product: lowest price, stores, whether any store has it; confirmed listings only.  The
    aggregate stands below every join, so partial sums leave the scan and not its rows."""
    return listings.filter("match_status = 'confirmed'").groupBy("product_id").agg(F.min("price").alias("min_price"), F.countDistinct("store_id").alias("n_stores"), F.bool_or(F.col("stock_status") == "disponible").alias("available"))


def matching_products(products: DataFrame, listings: DataFrame, f: ProductFilters) -> DataFrame:
    """All products with a confirmed listing that pass the filters; ``score`` is null without a text."""
    for name in ("game_slug", "category_slug", "set_code", "language", "is_hot"):
        if getattr(f, name) is not None:
            products = products.filter(F.col(name) == F.lit(getattr(f, name)))
    score = F.lit(None).cast("double") if f.text is None else similarity(trigrams(F.col("name_canonical")), trigrams(F.lit(f.text)))
    products = products.withColumn("score", score)
    if f.text is not None:
        products = products.filter(F.col("score") > FUZZY_LEAST)
    found = products.join(confirmed_aggregates(listings), "product_id")
    if f.min_price is not None:
        found = found.filter(F.col("min_price") >= F.lit(f.min_price))
    if f.max_price is not None:
        found = found.filter(F.col("min_price") <= F.lit(f.max_price))
    return found


def flat_categories(categories: DataFrame) -> DataFrame:
    """All categories without their tree, with the place of each by name."""
    return categories.select("id", "name", "slug", F.row_number().over(Window.orderBy("name", "id")).alias("place"))


def raw_products(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` ids with their product as it stands, whether it has listings or not: code 200, or 404."""
    known = products.withColumn("_known", F.lit(True))
    return wanted.join(known, "product_id", "left").withColumn("code", F.when(F.col("_known"), 200).otherwise(404)).drop("_known")


def detailed_stores(stores: DataFrame, health: DataFrame) -> DataFrame:
    """Every store with its state (store_id, last_scraped_at, consecutive_failures, backoff_until), where there is one,
    and its place by name."""
    d = stores.join(health.select("store_id", "last_scraped_at", "consecutive_failures", "backoff_until"), "store_id", "left")
    place = F.row_number().over(Window.orderBy("store_name", "store_id"))  # of all shops: a short list
    return d.withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0))).withColumn("place", place)


def search(products: DataFrame, listings: DataFrame, f: ProductFilters) -> DataFrame:
    """One page: best score first, then by id."""
    limit = min(f.limit, PAGE_LIMIT)
    return matching_products(products, listings, f).orderBy(F.desc_nulls_last("score"), "product_id").offset((max(1, f.page) - 1) * limit).limit(limit)


def page_links(total: int, page: int, limit: int) -> dict[str, int]:
    """Numbers of the next and previous page, where there are such."""
    pages = -(-total // limit)
    return ({"next": page + 1} if page < pages else {}) | ({"prev": page - 1} if page > 1 else {})


def product_listings(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Confirmed listings with their store, cheapest first in each product, null prices last (``place``)."""
    order = Window.partitionBy("product_id").orderBy(F.asc_nulls_last("price"), "store_id")
    return listings.filter("match_status = 'confirmed'").join(stores, "store_id").withColumn("place", F.row_number().over(order))


def daily_curve(history: DataFrame, store_id: int | None = None) -> DataFrame:
    """Lowest price per product and day; available if any store is, else sold out."""
    if store_id is not None:
        history = history.filter(F.col("store_id") == store_id)
    some = F.bool_or(F.col("stock_status") == "disponible")
    return history.groupBy("product_id", "scraped_date").agg(F.min("price").alias("price"), F.when(some, "disponible").otherwise("agotado").alias("stock_status"))


def category_tree(leaves: DataFrame, parent: str, child: str) -> DataFrame:
    """A row per parent with its children, sorted."""
    pairs = leaves.filter(F.col(parent).isNotNull()).select(parent, child).distinct()
    return pairs.groupBy(parent).agg(F.sort_array(F.collect_set(child)).alias("children"))


def deals(products: DataFrame, listings: DataFrame, stores: DataFrame, history: DataFrame, today, days: int = 7, limit: int | None = None) -> DataFrame:
    """Products in stock somewhere whose lowest price is below that of exactly ``days`` ago.

    The cheapest store's name goes along (ties: the smaller store id).  As in a shop window, the
    lowest price may come from a store that is sold out while another has stock."""
    now = listings.filter("match_status = 'confirmed'").join(stores.select("store_id", "store_name"), "store_id", "left")
    now = now.groupBy("product_id").agg(F.min("price").alias("price"), F.bool_or(F.col("stock_status") == "disponible").alias("available"), F.min_by("store_name", F.when(F.col("price").isNotNull(), F.struct("price", "store_id"))).alias("store_name"))
    then = history.filter(F.col("scraped_date") == F.date_sub(F.lit(today), days)).groupBy("product_id").agg(F.min("price").alias("price_before"))
    both = now.filter("available").join(then, "product_id").filter("price < price_before").join(products.select("product_id", "name_canonical"), "product_id")
    out = both.select("product_id", "name_canonical", "store_name", "price", "price_before", drop_percent(F.col("price_before"), F.col("price")).alias("drop_percent"))
    return out if limit is None else out.orderBy(F.desc("drop_percent"), "product_id").limit(limit)
