import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.operators.ingest import listed_urls, paced
from pricetide.operators.stock import failure_runs, pause_ends, transitions
from pricetide.plans.adapters import Domain
from pricetide.sources.snapshots import SnapshotTable
from pricetide.streaming import notify
from pricetide.streaming.failures import failure_states
from pricetide.streaming.restock import notify_once, restocks
from pricetide.streaming.urls import new_urls

FOLDER = "/root/testdata/sf0.001"
START = dt.datetime(2026, 1, 1)


def stream_of(spark, tmp_path, batches, shape):
    """A stream with one micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def run(spark, df, tmp_path):
    notify_once(df, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def parts(df, *order):
    """Three micro-batches in order."""
    cut = df.withColumn("part", F.ntile(3).over(Window.orderBy(*order)))
    return [[tuple(r)[:-1] for r in cut.filter(F.col("part") == k).collect()] for k in (1, 2, 3)]


def test_stream_agrees_with_batch(spark, tmp_path):
    batch = Domain(spark, FOLDER).signal.withColumn("ts", F.col("ts").cast("timestamp"))
    shape = "listing_id long, ts timestamp, event_id long, stock_status string"
    got = {r.event_id for r in run(spark, restocks(stream_of(spark, tmp_path, parts(batch, "ts", "event_id"), shape), 1), tmp_path)}
    assert got == {r.event_id for r in transitions(batch, forget_days=1).collect()}
    assert got < {r.event_id for r in transitions(batch).collect()}  # silences count


def test_listings_are_forgotten(spark, tmp_path):
    day = lambda k: START + dt.timedelta(days=k)
    rows = [[(1, day(0), 1, "agotado"), (2, day(0), 2, "agotado"), (2, day(0), 3, "disponible")], [(9, day(40), 4, "agotado")], [(9, day(41), 5, "agotado")], [(1, day(42), 6, "disponible"), (9, day(42), 7, "disponible"), (9, day(0), 8, "agotado")]]
    df = restocks(stream_of(spark, tmp_path, rows, "listing_id long, ts timestamp, event_id long, stock_status string"), 30)
    query = notify_once(df, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(300)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [3, 7]
    state = [(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsRemoved"]) for p in query.recentProgress]
    assert (1, 2) in state  # the two silent ones went, without a row of theirs


def test_failures_on_a_stream_agree_with_batch(spark, tmp_path):
    runs = Domain(spark, FOLDER).signal.select(F.col("listing_id").cast("long").alias("store_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("run_id"), F.when(F.col("stock_status") == "agotado", True).when(F.col("event_id") % 3 > 0, False).alias("failed"))
    later = runs.agg(F.max("ts")).first()[0] + dt.timedelta(days=9)
    end = [(-1, later, 10**6, None)]
    shape = "store_id long, ts timestamp, run_id long, failed boolean"
    rows = run(spark, failure_states(stream_of(spark, tmp_path, [*parts(runs, "ts", "run_id"), end], shape), 2, 86_400), tmp_path)
    got = {(r.run_id, r.failures, r.backoff_until) for r in rows if r.run_id is not None and r.store_id >= 0}
    want = failure_runs(runs, "store_id", "ts", "run_id", "failed", 2, 86_400).collect()
    assert got == {(r.run_id, r.failures, r.backoff_until) for r in want} and any(r.backoff_until for r in want)
    ends = sorted((r.store_id, r.ts, r.failures) for r in rows if r.run_id is None)
    assert ends == sorted(tuple(r) for r in pause_ends(runs, "store_id", "ts", "run_id", "failed", 2, 86_400).collect()) and ends


def test_pauses_end_by_themselves(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    one = [(1, at(0), 1, True), (1, at(1), 2, True), (2, at(0), 1, True), (2, at(0), 2, True), (3, at(0), 1, True), (3, at(1), 2, True)]
    same = [(2, at(0), 3, True), (3, at(5), 3, False), (4, at(0), 1, False)]  # equal time stamps in a later batch
    late = [(9, at(600), 1, None)]
    last = [(1, at(601), 3, True), (1, at(1), 2, True), (9, at(700), 2, None)]
    df = failure_states(stream_of(spark, tmp_path, [one, same, late, last], "store_id long, ts timestamp, run_id long, failed boolean"), 2, 600)
    rows = run(spark, df, tmp_path)
    got = sorted((r.store_id, r.run_id, r.failures) for r in rows if r.store_id < 9 and r.run_id is not None)
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 1), (3, 2, 2), (3, 3, 0), (4, 1, 0)]
    ends = sorted((r.store_id, r.ts, r.failures) for r in rows if r.run_id is None)
    assert ends == [(1, at(11), 2), (1, at(611), 3), (2, at(10), 3)]


def test_paced_urls_equal_a_queue(spark):
    rng = random.Random(5)
    rows = [(s, f"u{k:03}", rng.randint(0, 9)) for s in range(6) for k in range(rng.choice([0, 1, 40]))]
    got = {(r.store_id, r.url): r.slot for r in paced(spark.createDataFrame(rows, "store_id long, url string, period long"), 3, ["url"]).collect()}
    want = {}
    for s in range(6):
        taken = {}
        for _, url, period in sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])):
            slot = max(period, max(taken, default=0))
            slot += taken.get(slot, 0) == 3
            taken[slot] = taken.get(slot, 0) + 1
            want[s, url] = slot
    assert got == want


def test_new_urls_on_a_stream(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    entry = lambda s, k, m, kind="card": (s, f"https://s{s}/p/{kind}-{k:02}", at(m))
    one = [entry(1, k, 0) for k in range(8)] + [(1, "https://s1/q/card-1", at(0)), entry(1, 50, 0, "other"), entry(2, 1, 0), (2, "https://s2/any/CARD-9", at(1))]
    two = [entry(1, k, 30) for k in range(9)] + [entry(1, 20, 70), entry(2, 1, 70), entry(2, 2, 130)]
    three = [entry(3, 1, 3000)]
    known = spark.createDataFrame([(1, "https://s1/p/card-00"), (1, None), (2, "https://s2/x")], "store_id long, url string")
    shape = "store_id long, url string, ts timestamp"
    got = sorted((r.store_id, r.url[8:], r.period) for r in run(spark, new_urls(stream_of(spark, tmp_path, [one, two, three], shape), known, ["card"], 3, 3600), tmp_path))
    hour = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    first = spark.createDataFrame(one + two + three, shape).groupBy("store_id", "url").agg(F.min("ts").alias("ts"))
    batch = listed_urls(first, known, ["card"]).withColumn("period", F.floor(F.unix_seconds("ts") / 3600))
    want = sorted((r.store_id, r.url[8:], r.slot) for r in paced(batch, 3, ["ts", "url"]).collect())
    assert got == want
    assert [p - hour for s, _, p in got if s == 1] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and [u for s, u, _ in got if s == 2] == ["s2/any/CARD-9", "s2/p/card-01", "s2/p/card-02"]


def notify_tables(spark, folder):
    shape = lambda s: spark.createDataFrame([], s).schema
    make = lambda name, s, key: SnapshotTable.create(spark, f"{folder}/{name}", shape(s), key, 4)
    return notify.Tables(
        make("events", "event_id long, product_id int, store_id int, subscribers_notified long", ["event_id"]),
        make("subscriptions", "subscription_id long, product_id int, store_id int, push_endpoint string", ["subscription_id"]),
        make("deliveries", notify.DELIVERY, ["event_id", "subscription_id"]),
    )


def test_replayed_batches_tell_nobody_twice(spark, tmp_path):
    tables = notify_tables(spark, f"{tmp_path}/t")
    follows = [(1, 7, None, "ok1"), (2, 7, 5, "ok2"), (3, 7, 6, "other store"), (4, 8, None, "other product"), (5, 7, 5, "gone"), (6, 7, None, "busy")]
    notify.persist.upsert(tables.subscriptions, spark.createDataFrame(follows, "subscription_id long, product_id int, store_id int, push_endpoint string"), [])
    told = []

    def send(messages):
        told.extend((r.event_id, r.push_endpoint, r.name_canonical) for r in messages.collect())
        outcome = F.when(F.col("push_endpoint") == "gone", "dead").when(F.col("push_endpoint") == "busy", "failed").otherwise("sent")
        return messages.withColumn("outcome", outcome)

    products = spark.createDataFrame([(7, "Box"), (8, "Case")], "product_id int, name_canonical string")
    shape = "event_id long, product_id int, store_id int"
    batches = [[(10, 7, 5)], [(11, 7, 6), (12, 9, 5), (10, 7, 5)], [(13, 7, 5), (10, 7, 5)]]
    stream = stream_of(spark, tmp_path, batches, shape)
    start = lambda name: notify.start(stream, tables, products, send, f"{tmp_path}/{name}").awaitTermination(300)
    start("check")
    first = sorted(told)
    assert first == [(10, "busy", "Box"), (10, "gone", "Box"), (10, "ok1", "Box"), (10, "ok2", "Box"), (11, "busy", "Box"), (11, "ok1", "Box"), (11, "other store", "Box"), (13, "busy", "Box"), (13, "ok1", "Box"), (13, "ok2", "Box")]
    start("lost checkpoint")  # all batches come again
    assert sorted(told) == first
    assert sorted((r.event_id, r.subscribers_notified) for r in tables.events.read().collect()) == [(10, 2), (11, 2), (12, 0), (13, 2)]
    assert sorted(r.subscription_id for r in tables.subscriptions.read().collect()) == [1, 2, 3, 4, 6]


def test_a_crash_while_sending_tells_nobody_twice(spark, tmp_path):
    tables = notify_tables(spark, f"{tmp_path}/t")
    notify.persist.upsert(tables.subscriptions, spark.createDataFrame([(k, 7, None, f"e{k}") for k in range(4)], "subscription_id long, product_id int, store_id int, push_endpoint string"), [])
    products = spark.createDataFrame([(7, "Box")], "product_id int, name_canonical string")
    events = spark.createDataFrame([(1, 7, 5)], "event_id long, product_id int, store_id int")
    told = []

    def crash(messages):
        told.extend(r.push_endpoint for r in messages.collect())
        raise OSError("driver lost")

    try:
        notify.batch(events, tables, products, crash)
    except OSError:
        pass
    notify.batch(events, tables, products, lambda m: told.extend(r.push_endpoint for r in m.collect()) or m.withColumn("outcome", F.lit("sent")))
    assert sorted(told) == ["e0", "e1", "e2", "e3"]
    assert {r.outcome for r in tables.deliveries.read().collect()} == {"claimed"}  # nobody knows what became of them
