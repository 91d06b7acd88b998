"""Telling subscribers of restocks, each of them once.

A micro-batch of events is joined with who follows the product, in any store or in this one.  Who is to be told is
written down first (``claimed``), in one commit; only pairs that were not there before are sent.
So a batch that comes again, or that a lost driver left half done, tells nobody twice; those
claimed whose outcome never came were told or not, and are not told again.  Afterwards each event gets
the number of those told, and subscriptions that proved dead go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import persist
from pricetide.sources.snapshots import SnapshotTable
from pricetide.sources.storage import written

DELIVERY = "event_id long, subscription_id long, claim string, outcome string"


@dataclass(frozen=True)
class Tables:
    """events: by event_id, with product_id, store_id, subscribers_notified; subscriptions: by subscription_id, with
    product_id, store_id (null: any), push_endpoint; deliveries: by event_id and subscription_id."""

    events: SnapshotTable
    subscriptions: SnapshotTable
    deliveries: SnapshotTable


def batch(events: DataFrame, tables: Tables, products: DataFrame, send: Callable[[DataFrame], DataFrame]) -> None:
    """``events``: event_id, product_id, store_id.  ``send`` is given event_id, subscription_id, push_endpoint and
    name_canonical, and adds ``outcome``: sent, dead (the subscription is to go) or failed."""
    events = written(events.select("event_id", "product_id", "store_id").dropDuplicates(["event_id"]), "events")
    persist.upsert(tables.events, events.withColumn("subscribers_notified", F.lit(None).cast("long")), [])
    e, s = events.alias("e"), tables.subscriptions.read().alias("s")
    follows = (F.col("e.product_id") == F.col("s.product_id")) & (F.col("s.store_id").isNull() | (F.col("s.store_id") == F.col("e.store_id")))
    pairs = e.join(s, follows).select("event_id", "subscription_id", "e.product_id", "push_endpoint")
    fresh = pairs.join(tables.deliveries.read().select("event_id", "subscription_id"), ["event_id", "subscription_id"], "left_anti")
    fresh = fresh.join(products.select("product_id", "name_canonical"), "product_id").drop("product_id")
    mine = events.sparkSession.sql("select uuid()").first()[0]
    fresh = written(fresh.withColumn("claim", F.lit(mine)), "claims")
    persist.upsert(tables.deliveries, fresh.select("event_id", "subscription_id", "claim", F.lit("claimed").alias("outcome")), [])
    # another writer's claim on the same pair may have come first
    own = tables.deliveries.read().filter((F.col("claim") == mine) & (F.col("outcome") == "claimed")).select("event_id", "subscription_id")
    messages = written(fresh.join(own, ["event_id", "subscription_id"], "left_semi").drop("claim"), "messages")
    if not messages.isEmpty():
        outcomes = written(send(messages).select("event_id", "subscription_id", "outcome"), "outcomes")
        persist.upsert(tables.deliveries, outcomes, ["outcome"])
    done = tables.deliveries.read().join(events.select("event_id"), "event_id", "left_semi")
    told = done.groupBy("event_id").agg(F.count_if(F.col("outcome") == "sent").alias("subscribers_notified"))
    counted = events.select("event_id").join(told, "event_id", "left").fillna(0, ["subscribers_notified"])
    persist.upsert(tables.events, counted, ["subscribers_notified"])
    persist.delete(tables.subscriptions, done.filter("outcome = 'dead'").select("subscription_id"))


def start(restocks: DataFrame, tables: Tables, products: DataFrame, send: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start an available-now query over a stream of events."""
    each = restocks.writeStream.foreachBatch(lambda rows, _: batch(rows, tables, products, send))
    return each.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
