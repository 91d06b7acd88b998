"""Stock: restock transitions, the restock feed, subscriber fan-out, store failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(signals: DataFrame, key: str = "listing_id", time: str = "ts", tie: str = "event_id", forget_days: int | None = None) -> DataFrame:
    """Signals that turn a listing from sold out to available.  First sightings and signals after an
    unknown state never do, nor what follows a silence of more than ``forget_days``."""
    own = Window.partitionBy(key).orderBy(time, tie)
    before = F.lag("stock_status").over(own)
    if forget_days is not None:
        silence = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(own).cast("timestamp"))
        before = F.when(silence <= forget_days * 86_400_000_000, before)
    return signals.withColumn("before", before).filter("before = 'agotado' and stock_status = 'disponible'").drop("before")


def restock_events(previous: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """New states that restock a listing with a known product; keys are compared null-safe."""
    left, right = now.alias("n"), previous.alias("p")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    turned = (F.col("p.stock_status") == "agotado") & (F.col("n.stock_status") == "disponible") & F.col("p.product_id").isNotNull()
    return left.join(right, [*same, turned]).select(*(F.col(f"n.{k}").alias(k) for k in key), F.col("p.product_id").alias("product_id"))


def restock_feed(events: DataFrame, products: DataFrame, stores: DataFrame, now, hours: int, limit: int | None = None, game: str | None = None, category: str | None = None, listings: DataFrame | None = None) -> DataFrame:
    """Restocks of the last hours with product and store, newest first; of one game or category only, if named, and with
    the listing's present ``price``, if ``listings`` (store_id, product_id) are given."""
    recent = events.filter(F.col("detected_at") >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    wanted = {"game_slug": game, "category_slug": category}
    for column, slug in wanted.items():
        products = products if slug is None else products.filter(F.col(column) == slug)
    out = recent.join(products, "product_id").join(stores, "store_id")
    if listings is not None:
        out = out.join(listings.select("store_id", "product_id", "price"), ["store_id", "product_id"])
    return out if limit is None else out.orderBy(F.desc("detected_at"), "event_id").limit(min(limit, 200))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """An event's subscribers: those of its product in any store or in its store.  The product is the
    join's key, the store a condition on top, so no nested loops."""
    e, s = events.alias("e"), subscriptions.alias("s")
    fits = (F.col("e.product_id") == F.col("s.product_id")) & (F.col("s.store_id").isNull() | (F.col("s.store_id") == F.col("e.store_id")))
    return e.join(s, fits).select("e.*", F.col("s.subscriber_id").alias("subscriber_id"))


def failure_runs(runs: DataFrame, key: str, time: str, tie: str, failed: str, threshold: int = 3, pause_seconds: int = 1800) -> DataFrame:
    """Consecutive failures at each run (a success starts anew) and, from the threshold on, until when
    the store is left alone.  A run that is neither (null) changes nothing."""
    order = Window.partitionBy(key).orderBy(time, tie)
    runs = runs.withColumn("_island", F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum(F.col(failed).cast("long")).over(Window.partitionBy(key, "_island").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("failures", F.coalesce(count, F.lit(0))).drop("_island")
    return runs.withColumn("backoff_until", F.when(F.col(failed) & (F.col("failures") >= threshold), F.col(time) + F.make_dt_interval(secs=F.lit(pause_seconds))))


def pause_ends(runs: DataFrame, key: str, time: str, tie: str, failed: str, threshold: int = 3, pause_seconds: int = 1800) -> DataFrame:
    """(key, ts, failures): when a pause runs out.  One that a success cuts short, or a further failure makes longer,
    before its end does not."""
    counted = failure_runs(runs.filter(F.col(failed).isNotNull()), key, time, tie, failed, threshold, pause_seconds)
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    ended = counted.withColumn("_next", following).filter(F.col("backoff_until").isNotNull() & F.coalesce(F.col("_next") >= F.col("backoff_until"), F.lit(True)))
    return ended.select(key, F.col("backoff_until").alias("ts"), "failures")


def runnable(stores: DataFrame, now) -> DataFrame:
    """Active stores that are not being left alone."""
    return stores.filter(F.col("active") & F.coalesce(F.col("backoff_until") <= F.lit(now), F.lit(True)))
