"""Writing batches to versioned tables: upserts, deletions, and the ingest of a scrape.

A commit reads the buckets that its keys fall into, as of one version, and writes them anew.  If another
writer was faster on one of them, the same step is done again on what is there now.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators import ingest, stock
from pricetide.sources.snapshots import BUCKET, SLICE, Outdated, SnapshotTable
from pricetide.sources.storage import written

LISTING_VALUES = ["store_sku", "raw_name", "raw_tags", "price", "stock_status", "last_etag", "last_modified", "last_checked_at"]
STORE_VALUES = ["name", "platform"]
TRIES = 5


def _retried(table: SnapshotTable, touched: list[int], change: Callable[[DataFrame], DataFrame], note: str | None) -> tuple[int, int]:
    """(version before, version after); the same twice if there was nothing to do."""
    for _ in range(TRIES):
        base = table.version()
        if not touched:
            return base, base
        try:
            return base, table.commit(base, change(table.read(base, touched)), touched, note)
        except Outdated:
            continue
    raise Outdated(f"{TRIES} tries on {table.folder}")


def upsert(table: SnapshotTable, new: DataFrame, updated: list[str], note: str | None = None, at_rest: bool = False) -> tuple[int, int]:
    """Rows of new keys are inserted; of known keys the ``updated`` columns change.  Without any this appends what
    is not there yet, so a repeated batch adds nothing.  One row per key.  (version before, version after).

    ``at_rest``: the rows are read from files that stay as they are, so they are not written first."""
    new = new if at_rest else written(new, "batch")
    return _retried(table, table.touched(new), lambda old: ingest.merge_snapshot(old, new, table.key, updated, table.dealt, (BUCKET, SLICE)), note)


def delete(table: SnapshotTable, keys: DataFrame, note: str | None = None) -> tuple[int, int]:
    """Rows of the given keys go; nulls in keys equal each other."""
    keys = written(keys.select(*table.key).distinct(), "keys")

    def without(old: DataFrame) -> DataFrame:
        rest = [f for f in old.schema if f.name not in table.key]
        row = F.struct(F.lit(1).alias("_kept"), *(f.name for f in rest))
        none = keys.select(*table.key, F.lit(None).cast(old.select(row.alias("_row")).schema[0].dataType).alias("_row"))
        met = table.dealt(old.select(*table.key, row.alias("_row")).unionByName(none)).groupBy(BUCKET, SLICE, *table.key)
        left = met.agg(F.max("_row").alias("_row"), F.count_if(F.col("_row").isNull()).alias("_gone")).filter("_gone = 0")
        return left.select(BUCKET, *table.key, *(F.col("_row")[f.name].alias(f.name) for f in rest))

    return _retried(table, table.touched(keys), without, note)


def sync_stores(table: SnapshotTable, stores: DataFrame) -> tuple[int, int]:
    """Shops by address (``website_url``): name and platform follow ``stores``, everything else stays.  New ones get the
    numbers after the greatest, in order of their addresses.  A shop may come once."""
    stores = written(stores.select("website_url", *STORE_VALUES), "stores")
    known = table.read()
    start = known.agg(F.coalesce(F.max("store_id"), F.lit(0))).first()[0]
    fresh = stores.join(known.select("website_url"), "website_url", "left_anti")
    place = F.row_number().over(Window.orderBy("website_url"))  # of the shops that are new at once
    numbered = fresh.select("website_url", (place + start).cast(table.schema["store_id"].dataType).alias("store_id"))
    return upsert(table, stores.join(numbered, "website_url", "left"), STORE_VALUES)


@dataclass(frozen=True)
class Tables:
    """listing: by store_id, store_url, raw_variant; history: these and scraped_date; restock: these and batch."""

    listing: SnapshotTable
    history: SnapshotTable
    restock: SnapshotTable


def ingest_batch(tables: Tables, rows: DataFrame, batch: str, day, now) -> DataFrame:
    """Take a scrape into the tables; its restocks (key, product_id, batch, detected_at).

    Rows are checked and shops with a repeated key left out as a whole.  The listing table's commit bears the batch's
    name, and history and restocks follow from the versions before and after it: a batch that was cut
    off in between, or comes again, goes on where it was and adds nothing twice."""
    key = tables.listing.key
    after = tables.listing.version_of(batch)
    if after is None:
        taken = written(ingest.accepted(rows, key).withColumn("last_checked_at", F.lit(now)), "accepted")
        before, after = upsert(tables.listing, taken, [c for c in LISTING_VALUES if c in taken.columns], batch, at_rest=True)
        if before == after:  # nothing came
            return tables.restock.read(buckets=[])
    # the one before, whoever wrote it: its buckets that changed are this batch's
    old, new = tables.listing.paths(after - 1), tables.listing.paths(after)
    buckets = [b for b, p in new.items() if old.get(b) != p]
    previous, current = tables.listing.read(after - 1, buckets), tables.listing.read(after, buckets)
    mine = current.filter(F.col("last_checked_at") == F.lit(now))
    # a step whose commit bears the batch's name is done
    if tables.history.version_of(batch) is None:
        upsert(tables.history, mine.select(*key, F.lit(day).alias("scraped_date"), "price", "stock_status"), ["price", "stock_status"], batch, at_rest=True)
    if tables.restock.version_of(batch) is None:
        events = stock.restock_events(previous, mine, key).select(*key, "product_id", F.lit(batch).alias("batch"), F.lit(now).alias("detected_at"))
        upsert(tables.restock, events, [], batch)
    return tables.restock.read().filter(F.col("batch") == batch)
