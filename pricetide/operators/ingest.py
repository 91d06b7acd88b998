"""Idempotent ingest: quarantine, null-safe snapshot merge, daily prices, catalog seed, new URLs.

State tables are snapshots: a merge gives the new snapshot as a DataFrame, which is written beside
the old one (``sources.sinks``); nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pricetide.functions import tables as t
from pricetide.functions.classify import classify
from pricetide.functions.columns import first_case
from pricetide.sources.sinks import PRODUCT_FIELDS

KEY = ["store_id", "store_url", "raw_variant"]
WIDTHS = {"store_sku": 255, "raw_name": 500, "raw_variant": 255}
STOCK = ["disponible", "agotado", "desconocido"]


def valid_rows(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Rows with a URL and a name, texts cut to their columns' widths, stock in the known words.  An
    observation counts rows ``dropped``, and texts ``cut`` among the rows kept."""
    if observation is not None:
        good = (F.coalesce("store_url", F.lit("")) != "") & (F.coalesce("raw_name", F.lit("")) != "")
        cut = sum((F.coalesce(F.length(c) > w, F.lit(False)).cast("long") for c, w in WIDTHS.items() if c in rows.columns), F.lit(0))
        rows = rows.observe(observation, F.count_if(~good).alias("dropped"), F.coalesce(F.sum(F.when(good, cut)), F.lit(0)).alias("cut"))
    rows = rows.filter((F.coalesce("store_url", F.lit("")) != "") & (F.coalesce("raw_name", F.lit("")) != ""))
    for name, width in WIDTHS.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.substring(name, 1, width))
    low = F.lower("stock_status")
    return rows.withColumn("stock_status", F.when(low.isin(STOCK), low).otherwise("desconocido"))


def product_rows(parsed: DataFrame, store: str = "store", platform: str = "platform") -> DataFrame:
    """Rows of any parser as products (``sinks.PRODUCT_FIELDS`` and tags), classified by name, variant and tags.  What a
    parser does not know is null."""
    known = parsed.select("*", *(F.lit(None).cast("string").alias(c) for c in ("id_product", "variant", "tags", "sku", "image_url", "url") if c not in parsed.columns))
    texts = ["id_product", "name", "variant", "url", "sku", "image_url", "tags"]
    c = classify(known.withColumns({t_: F.col(t_).cast("string") for t_ in texts}), "name", "variant", "tags", "_class")
    values = {"store": F.col(store), "platform": F.col(platform)} | {k: F.col(f"_class.{k}") for k in ("product_type", "main_set", "set_code", "language")}
    return c.select(*(values.get(f, F.col(f)).alias(f) for f in [*PRODUCT_FIELDS, "tags"]))


def scraped_rows(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Products as rows for ``accepted``, with their store's id by its name (``store_id``, ``store_name``); rows of
    unknown stores are left out."""
    ids = stores.groupBy(F.col("store_name").alias("store")).agg(F.min("store_id").alias("store_id"))
    names = {"url": "store_url", "variant": "raw_variant", "sku": "store_sku", "name": "raw_name", "tags": "raw_tags"}
    return products.join(ids, "store").select("store_id", *(F.col(c).alias(n) for c, n in names.items()), "price", "stock_status")


def quarantined_stores(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Stores whose batch holds a key twice; nulls in a key equal each other."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(key[0]).distinct()


def accepted(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Valid rows of stores without a conflict: a store is taken whole or not at all."""
    rows = valid_rows(rows)
    return rows.join(quarantined_stores(rows, key), key[0], "left_anti")


def merge_snapshot(old: DataFrame, new: DataFrame, key: list[str], updated: list[str], dealt: Callable[[DataFrame], DataFrame] | None = None, places: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after an upsert: ``updated`` columns come from the new row where there is one, all
    others stay; unseen keys are inserted.  Keys are compared null-safe.

    Old and new rows meet in one aggregation over the key, so each side is shuffled once and null
    keys group by themselves.  ``dealt`` puts rows where they are to be written and adds ``places`` (functions of the key),
    which the result keeps."""
    columns = old.columns
    fill = lambda df, flag: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns), F.lit(flag).alias("_new"))
    both = fill(old, 0).unionByName(fill(new, 1))
    rest = [c for c in columns if c not in key]
    row = F.struct(*rest)
    merged = (dealt(both) if dealt else both).groupBy(*places, *key).agg(F.max(F.when(F.col("_new") == 0, row)).alias("_o"), F.max(F.when(F.col("_new") == 1, row)).alias("_n"))
    pick = lambda c: F.when(F.col("_n").isNotNull() & (F.lit(c in updated) | F.col("_o").isNull()), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return merged.select(*places, *(F.col(c) if c in key else pick(c).alias(c) for c in columns))


def touch(old: DataFrame, seen: DataFrame, key: list[str], column: str, now) -> DataFrame:
    """Unchanged listings: only the time of the last check moves."""
    o, s = old.alias("o"), seen.select(*key).distinct().withColumn("_seen", F.lit(True)).alias("s")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    value = F.when(F.col("s._seen"), F.lit(now)).otherwise(F.col(f"o.{column}"))
    return o.join(s, same, "left").select(*(value.alias(c) if c == column else F.col(f"o.{c}").alias(c) for c in old.columns))


def daily_prices(history: DataFrame, observed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per listing and day: the day's last observation wins over what was there, null price or not."""
    both = history.withColumn("_new", F.lit(0)).unionByName(observed.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def expand_catalog(releases: DataFrame, name: str = "name", code: str = "code", category: str = "category_slug") -> DataFrame:
    """Canonical names of official releases: pack, box, display and case, in English and, for some
    categories, Japanese: release name, first code and language."""
    n = F.col(name)

    def swapped(labels: dict[str, str], suffix: Column | None = None) -> Column:
        return first_case([(n.startswith(old), F.concat(F.lit(new), F.substring(n, len(old) + 1, 10_000), suffix if suffix is not None else F.lit(""))) for old, new in labels.items()])

    units = F.when(n.startswith("Premium Booster:"), "10").otherwise("12")
    variants = [
        F.struct(n.alias("name"), F.lit("sobre").alias("packaging")),
        F.struct(swapped(t.BOX_LABELS).alias("name"), F.lit("display").alias("packaging")),
        F.struct(swapped(t.DISPLAY_LABELS).alias("name"), F.lit("display").alias("packaging")),
        F.struct(swapped(t.CASE_LABELS, F.concat(F.lit(" (x"), units, F.lit(")"))).alias("name"), F.lit("case").alias("packaging")),
    ]
    languages = F.when(F.col(category).isin(t.JAPANESE_CATEGORIES), F.array(F.lit("EN"), F.lit("JP"))).otherwise(F.array(F.lit("EN")))
    rows = releases.withColumn("_v", F.explode(F.filter(F.array(*variants), lambda v: v["name"].isNotNull()))).withColumn("language", F.explode(languages))
    first_code = F.nullif(F.trim(F.split_part(F.coalesce(code, F.lit("")), F.lit("/"), F.lit(1))), F.lit(""))
    return rows.select(F.concat_ws(" ", F.col("_v.name"), first_code, F.col("language")).alias("name_canonical"), F.col("_v.packaging").alias("packaging"), "language", F.col(category).alias("category_slug"), first_code.alias("code"))


def seed_actions(catalog: DataFrame, seed: DataFrame, key: list[str], derived: list[str], known: Column | None = None) -> DataFrame:
    """What a seed does to each of its rows: skipped (not ``known``: its category is not in the catalog),
    inserted, updated (a derived column differs) or same.  The seed's rows of the first two kinds,
    put over the catalog's by ``merge_snapshot``, are the merged state."""
    c, s = catalog.alias("c"), seed.alias("s")
    same = F.lit(True)
    for d in derived:
        same = same & F.col(f"c.{d}").eqNullSafe(F.col(f"s.{d}"))
    joined = s.join(c, [F.col(f"c.{k}") == F.col(f"s.{k}") for k in key], "left")
    skipped = F.lit(False) if known is None else ~F.coalesce(known, F.lit(False))
    action = F.when(skipped, "skipped").when(F.col(f"c.{key[0]}").isNull(), "inserted").when(same, "same").otherwise("updated")
    return joined.select("s.*", action.alias("action"))


# BEGIN FIXED VALUES: new URLs that are fetched from a store at once
URLS_PER_POLL = 30
# END FIXED VALUES


def new_urls(found: DataFrame, known: DataFrame, prefix: str, words: list[str], cap: int = URLS_PER_POLL, store: str = "store_id", url: str = "url") -> DataFrame:
    """Sitemap URLs under a prefix that hold one of the words and are not known: the first of each store."""
    fits = F.col(url).startswith(prefix) & F.lower(url).rlike("|".join(words))
    fresh = found.filter(fits).select(store, url).distinct().join(known.select(url), url, "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(store).orderBy(url))).filter(F.col("place") <= cap)


def listed_urls(found: DataFrame, known: DataFrame, words: list[str], store: str = "store_id", url: str = "url") -> DataFrame:
    """Sitemap entries that look like products to be had: under one of the store's own prefixes, with one of the
    words in them, and not known.  A prefix is the address and first folder of a known URL below it; a store without
    known ones takes any."""
    parts = F.split(url, "/")
    prefix = F.when(F.size(parts) > 4, F.concat(F.array_join(F.slice(parts, 1, 4), "/"), F.lit("/")))
    own = known.filter(F.col(url).isNotNull()).select(store, prefix.alias("_prefix")).filter("_prefix is not null").distinct()
    has = own.select(store).distinct().withColumn("_has", F.lit(True))
    wordy = found.filter(F.lower(url).rlike("|".join(words))).withColumn("_prefix", prefix)
    fits = wordy.join(own.withColumn("_fits", F.lit(True)), [store, "_prefix"], "left").join(has, store, "left").filter("_fits or _has is null")
    return fits.select(found.columns).join(known.select(store, url).distinct(), [store, url], "left_anti")


def paced(urls: DataFrame, cap: int, order: list[str], store: str = "store_id", period: str = "period") -> DataFrame:
    """``urls`` with ``slot``: the period in which each is fetched if at most ``cap`` of a store are in one, the first
    in ``order`` first, none before its own ``period``.

    Of every cap-th URL each takes a later period than the one before, so the slot is a running maximum."""
    own = Window.partitionBy(store)
    d = urls.withColumn("_k", F.row_number().over(own.orderBy(period, *order)) - 1).withColumn("_turn", F.floor(F.col("_k") / cap))
    ahead = Window.partitionBy(store, F.col("_k") % cap).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("slot", F.max(F.col(period) - F.col("_turn")).over(ahead) + F.col("_turn")).drop("_k", "_turn")
