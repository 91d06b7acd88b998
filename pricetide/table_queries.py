"""Registered queries over versioned tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.catalog_queries import query
from pricetide.operators import ingest, persist, stock
from pricetide.plans.adapters import Domain
from pricetide.sources.snapshots import SnapshotTable
from pricetide.sources.storage import shared_folder, written
from pricetide.streaming import notify

_KEY = "store_id long, store_url string, raw_variant string"
_STATES = """, edge as (select date '1997-01-01' as a, date '1998-01-01' as b),
part_of as (select store_id, product_id, price, stock_status, scraped_date, l_orderkey, l_linenumber, case when scraped_date < a then 0 when scraped_date < b then 1 else 2 end as batch from price_history, edge),
state as (select * from part_of qualify row_number() over (partition by store_id, product_id, batch order by scraped_date desc, l_orderkey desc, l_linenumber desc) = 1)
"""


def _batches(d: Domain) -> DataFrame:
    """The last state of each listing before 1997, in 1997 and after, written once.  It is the last of all observations, so
    that those of a day need not be told apart first."""
    day = F.col("scraped_date")
    batch = F.when(day < "1997-01-01", 0).when(day < "1998-01-01", 1).otherwise(2)
    last = d.observation.withColumn("batch", batch).groupBy("store_id", "product_id", "batch").agg(F.max_by(F.struct("price", "stock_status"), F.struct("scraped_date", "seq")).alias("s"))
    variant = F.when(F.col("product_id") % 2 == 0, "V")
    states = last.select("store_id", F.concat(F.lit("u/"), "product_id").alias("store_url"), variant.alias("raw_variant"), "batch", "product_id", F.col("s.price").cast("decimal(12,2)").alias("price"), "s.stock_status")
    return written(states, "states")


def _folder(d: Domain) -> str:
    return f"{shared_folder(d.spark)}/pricetide-table-{uuid.uuid4().hex}"


@query(_STATES + """select store_id, product_id, cast(coalesce(arg_max(price, batch) filter (where batch < 2), arg_max(price, batch)) as double) as price,
  cast(max(price) filter (where batch = 0) as double) as price_as_of_1, max(batch) filter (where batch < 2) is not null or count(*) filter (where batch = 2 and stock_status = 'disponible') > 0 as kept
from state group by 1, 2 having max(batch) filter (where batch < 2) is not null or count(*) filter (where batch = 2 and stock_status = 'disponible') > 0""")
def versioned_table(d: Domain) -> DataFrame:
    """Three commits: a load, an upsert, an insert of unknown keys only; then keys that were never
    available go again.  The result shows the last version beside the first."""
    states = _batches(d).withColumnRenamed("product_id", "id")
    table = SnapshotTable.create(d.spark, _folder(d), states.drop("batch").schema, ["store_id", "store_url", "raw_variant"], 16)
    _, first = persist.upsert(table, states.filter("batch = 0").drop("batch"), [], at_rest=True)
    persist.upsert(table, states.filter("batch = 1").drop("batch"), ["price", "stock_status"], at_rest=True)
    _, before = persist.upsert(table, states.filter("batch = 2").drop("batch"), [], at_rest=True)
    known = states.filter("batch < 2").select(*table.key)
    late = table.read(before).join(known.withColumn("k", F.coalesce("raw_variant", F.lit(""))).drop("raw_variant").distinct(), ["store_id", "store_url"], "left_anti")
    persist.delete(table, late.filter("stock_status <> 'disponible'"))
    now, then = table.read(), table.read(first).select("store_id", "store_url", F.col("price").alias("then"))
    return now.join(then, ["store_id", "store_url"], "left").select("store_id", F.col("id").alias("product_id"), F.col("price").cast("double").alias("price"), F.col("then").cast("double").alias("price_as_of_1"), F.lit(True).alias("kept"))


@query(_STATES + """, seen as (select *, lag(stock_status) over (partition by store_id, product_id order by batch) as before from state)
select store_id, product_id, 'batch' || batch as batch from seen where batch > 0 and before = 'agotado' and stock_status = 'disponible'""")
def ingested_restocks(d: Domain) -> DataFrame:
    """Batches taken in one after the other, the last one twice, with an invalid row for every listing."""
    states = _batches(d)
    key = [c.split()[0] for c in _KEY.split(", ")]
    shapes = {"listing": "price decimal(12,2), stock_status string, raw_name string, product_id long, last_checked_at timestamp", "history": "scraped_date date, price decimal(12,2), stock_status string", "restock": "product_id long, batch string, detected_at timestamp"}
    keys = {"listing": key, "history": [*key, "scraped_date"], "restock": [*key, "batch"]}
    empty = {n: d.spark.createDataFrame([], f"{_KEY}, {s}").schema for n, s in shapes.items()}
    tables = persist.Tables(**{n: SnapshotTable.create(d.spark, _folder(d), empty[n], keys[n], 16) for n in shapes})
    start = dt.datetime(1996, 1, 1)
    rows = states.withColumn("raw_name", F.lit("name"))
    nameless = states.withColumn("raw_name", F.lit(None).cast("string"))
    for k in (0, 1, 2, 2):
        both = rows.unionByName(nameless).filter(F.col("batch") == k).drop("batch")
        persist.ingest_batch(tables, both, f"batch{k}", dt.date(1996 + k, 1, 1), start + dt.timedelta(days=365 * k))
    return tables.restock.read().select("store_id", "product_id", "batch")


_RUNS = """, runs as (select listing_id as store_id, ts, event_id, case when stock_status = 'agotado' then true when event_id % 3 > 0 then false end as failed from signal)
"""


@query(_RUNS + """, r as (with recursive step as (
  select *, row_number() over (partition by store_id order by ts, event_id) as k from runs where failed is not null),
go as (select store_id, k, ts, case when failed then 1 else 0 end as n from step where k = 1
  union all select s.store_id, s.k, s.ts, case when s.failed then g.n + 1 else 0 end from go g join step s on s.store_id = g.store_id and s.k = g.k + 1) select * from go)
select a.store_id, a.ts + interval 12 hour as ts, a.n as failures from r a left join r b on b.store_id = a.store_id and b.k = a.k + 1 where a.n >= 2 and (b.ts is null or b.ts >= a.ts + interval 12 hour)""")
def pauses_ended(d: Domain) -> DataFrame:
    """When pauses of half a day after two failures in a row run out; the twin of the stream's timers."""
    failed = F.when(F.col("stock_status") == "agotado", True).when(F.col("event_id") % 3 > 0, False)
    runs = d.signal.select(F.col("listing_id").alias("store_id"), "ts", "event_id", failed.alias("failed"))
    return stock.pause_ends(runs, "store_id", "ts", "event_id", "failed", 2, 43_200)


@query("""select event_id, listing_id from (select *, lag(stock_status) over w as before, lag(ts) over w as since from signal window w as (partition by listing_id order by ts, event_id))
where before = 'agotado' and stock_status = 'disponible' and ts - since <= interval 2 day""")
def restocks_not_forgotten(d: Domain) -> DataFrame:
    return stock.transitions(d.signal, forget_days=2).select("event_id", "listing_id")


_FOUND = """, known as (select l_suppkey as store_id, 'https://s' || l_suppkey || '/p/' || l_partkey as url from lineitem where l_suppkey % 4 > 0 and l_returnflag = 'R'),
entry as (select l_suppkey as store_id, 'https://s' || l_suppkey || case l_linenumber % 3 when 0 then '/q/' else '/p/' end || case when l_partkey % 5 < 2 then 'Card-' else '' end || l_partkey as url, min(l_shipdate) as ts from lineitem where l_shipdate >= date '1998-06-01' group by 1, 2),
fresh as (select * from entry e where contains(lower(url), 'card') and (store_id % 4 = 0 or url like 'https://s' || store_id || '/p/%') and not exists (select 1 from known k where k.url = e.url)),
"""


@query(_FOUND + """ranked as (select *, date_diff('day', date '1970-01-01', ts::date) as period, row_number() over (partition by store_id order by ts, url) as k from fresh),
slots as (with recursive s as (
  select store_id, url, k, period, period as slot, 1 as taken from ranked where k = 1
  union all select r.store_id, r.url, r.k, r.period, case when r.period > s.slot then r.period when s.taken < 2 then s.slot else s.slot + 1 end, case when r.period > s.slot or s.taken = 2 then 1 else s.taken + 1 end
  from s join ranked r on r.store_id = s.store_id and r.k = s.k + 1) select * from s)
select store_id, url, period, slot from slots""")
def paced_new_urls(d: Domain) -> DataFrame:
    """New card URLs of shops, two a day and shop at most; the twin of the stream that keeps the rest waiting."""
    li, card = d.raw("lineitem"), F.when(F.col("l_partkey") % 5 < 2, "Card-").otherwise("")
    base = F.concat(F.lit("https://s"), "l_suppkey")
    known = li.filter("l_suppkey % 4 > 0 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("store_id"), F.concat(base, F.lit("/p/"), "l_partkey").alias("url"))
    url = F.concat(base, F.when(F.col("l_linenumber") % 3 == 0, "/q/").otherwise("/p/"), card, "l_partkey")
    entries = li.filter("l_shipdate >= '1998-06-01'").groupBy(F.col("l_suppkey").alias("store_id"), url.alias("url")).agg(F.min("l_shipdate").alias("ts"))
    fresh = ingest.listed_urls(entries, known, ["card"]).withColumn("period", F.unix_date(F.col("ts").cast("date")).cast("long"))
    # within a day by time, as they came
    return ingest.paced(fresh, 2, ["ts", "url"]).select("store_id", "url", "period", "slot")


@query("""select event_id, cast(count(subscriber_id) filter (where subscriber_id % 5 > 1) as bigint) as sent, cast(count(subscriber_id) filter (where subscriber_id % 5 = 0) as bigint) as dead from (
  select event_id, listing_id + 1 as product_id, listing_id % 25 + 1 as store_id from (select *, lag(stock_status) over (partition by listing_id order by ts, event_id) as before from signal) where before = 'agotado' and stock_status = 'disponible') e
left join subscription s on s.product_id = e.product_id and (s.store_id is null or s.store_id = e.store_id) group by 1""")
def notified_once(d: Domain) -> DataFrame:
    """Restocks told to their subscribers, the batch coming twice; dead subscriptions are gone afterwards."""
    subscriptions = d.subscription.select(F.col("subscriber_id").alias("subscription_id"), F.col("product_id").cast("long").alias("product_id"), "store_id", F.lit("e").alias("push_endpoint"))
    shape = lambda s: d.spark.createDataFrame([], s).schema
    make = lambda s, key: SnapshotTable.create(d.spark, _folder(d), s, key, 8)
    tables = notify.Tables(make(shape("event_id long, product_id long, store_id long, subscribers_notified long"), ["event_id"]), make(subscriptions.schema, ["subscription_id"]), make(shape(notify.DELIVERY), ["event_id", "subscription_id"]))
    persist.upsert(tables.subscriptions, subscriptions, [])
    events = stock.transitions(d.signal).select("event_id", (F.col("listing_id") + 1).alias("product_id"), (F.col("listing_id") % 25 + 1).alias("store_id"))
    outcome = F.when(F.col("subscription_id") % 5 == 0, "dead").when(F.col("subscription_id") % 5 == 1, "failed").otherwise("sent")
    for _ in range(2):
        notify.batch(events, tables, d.product, lambda m: m.withColumn("outcome", outcome))
    gone = tables.deliveries.read().join(tables.subscriptions.read(), "subscription_id", "left_anti").groupBy("event_id").agg(F.count("*").alias("dead"))
    return tables.events.read().join(gone, "event_id", "left").select("event_id", F.col("subscribers_notified").alias("sent"), F.coalesce("dead", F.lit(0).cast("long")).alias("dead"))
