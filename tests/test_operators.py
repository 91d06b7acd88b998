import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricetide.functions import times
from pricetide.operators import catalog, changes, ingest, matching, stock
from pricetide.sources import payloads, sinks


def states(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


EVIDENCE = "id int, exact_name boolean, set_code_match boolean, language_match boolean, language_known boolean, packaging_match boolean, score double, is_fallback boolean, quantity_ambiguous boolean, single_product boolean"
DECISIONS = [
    ((False, None, True, True, True, 0.75, False, False, False), "confirmed"),
    ((False, None, True, True, True, 0.61, False, False, False), "confirmed"),
    ((False, None, True, True, True, 0.60, False, False, False), "needs_review"),
    ((False, None, True, True, True, 0.45, False, False, False), "needs_review"),
    ((False, None, True, True, True, 0.35, False, False, False), "needs_review"),
    ((False, None, True, True, True, 0.34, False, False, False), "unmatched"),
    ((False, None, False, True, True, 0.9, False, False, False), "needs_review"),
    ((False, None, False, False, True, 0.9, False, False, False), "needs_review"),
    ((False, False, True, True, True, 0.9, False, False, False), "unmatched"),
    ((True, False, True, True, True, 0.9, False, False, False), "confirmed"),
    ((False, True, True, True, True, 0.1, False, False, False), "confirmed"),
    ((False, True, True, True, False, 0.1, False, False, False), "needs_review"),
    ((False, True, True, True, True, 0.1, False, True, False), "needs_review"),
    ((False, True, True, True, True, 0.1, True, False, False), "needs_review"),
    ((False, True, True, True, True, 0.9, True, True, False), "confirmed"),
    ((False, None, False, False, True, 0.1, False, False, True), "confirmed"),
    ((False, None, True, True, True, 0.1, True, False, True), "unmatched"),
]


def test_decision_table(spark):
    df = spark.createDataFrame([(i, *e) for i, (e, _) in enumerate(DECISIONS)], EVIDENCE)
    assert {r.id: r.s for r in df.select("id", matching.decision().alias("s")).collect()} == {i: s for i, (_, s) in enumerate(DECISIONS)}


def test_merge_keeps_reviews_and_null_keys(spark):
    shape = "store_id int, store_url string, raw_variant string, product_id int, price decimal(10,2)"
    old = spark.createDataFrame([(1, "a", None, 7, Decimal("1.00")), (1, "b", "x", 8, Decimal("2.00"))], shape)
    new = spark.createDataFrame([(1, "a", None, None, Decimal("3.00")), (1, "c", None, None, None), (1, "b", "x", None, None)], shape)
    merged = ingest.merge_snapshot(old, new, ingest.KEY, ["price"])
    assert states(merged, *old.columns) == states(spark.createDataFrame([(1, "a", None, 7, Decimal("3.00")), (1, "b", "x", 8, None), (1, "c", None, None, None)], shape), *old.columns)


def test_conflicts_reject_their_store_only(spark):
    shape = "store_id int, store_url string, raw_variant string, raw_name string, store_sku string, stock_status string"
    rows = [(1, "a", None, "x", None, "DISPONIBLE"), (1, "a", None, "y", None, "AGOTADO"), (2, "a", None, "n" * 501, "s" * 300, "whatever"), (2, "", None, "x", None, None), (2, "b", None, None, None, None)]
    got = ingest.accepted(spark.createDataFrame(rows, shape)).collect()
    assert [(r.store_id, len(r.raw_name), len(r.store_sku), r.stock_status) for r in got] == [(2, 500, 255, "desconocido")]


@pytest.mark.parametrize(("before", "now", "product", "fires"), [(None, "disponible", 1, False), ("agotado", "disponible", 1, True), ("agotado", "disponible", None, False), ("desconocido", "disponible", 1, False), ("disponible", "agotado", 1, False)])
def test_restock_transitions(spark, before, now, product, fires):
    old = spark.createDataFrame([("k", None, product, before)] if before else [], "store_url string, raw_variant string, product_id int, stock_status string")
    new = spark.createDataFrame([("k", None, now)], "store_url string, raw_variant string, stock_status string")
    assert stock.restock_events(old, new, ["store_url", "raw_variant"]).count() == fires


def test_daily_price_last_write_wins_with_null(spark):
    shape = "listing int, day date, price double, seq int"
    d = dt.date(2024, 1, 1)
    out = ingest.daily_prices(spark.createDataFrame([(1, d, 5.0, 9)], shape), spark.createDataFrame([(1, d, 4.0, 1), (1, d, None, 2)], shape), ["listing", "day"], ["seq"])
    assert states(out, "price") == [(None,)]


def test_seed_expansion(spark):
    rel = spark.createDataFrame([("Booster Pack: Romance Dawn", "OP-01", "one-piece"), ("Playmat Nami", None, "playmat")], "name string, code string, category_slug string")
    got = {r.name_canonical for r in ingest.expand_catalog(rel).collect()}
    names = ["Booster Pack: Romance Dawn OP-01", "Booster Box: Romance Dawn OP-01", "Booster Box Case: Romance Dawn (x12) OP-01"]
    assert got == {f"{n} {x}" for n in names for x in ("EN", "JP")} | {"Playmat Nami EN"}


def test_deals(spark):
    today, before = dt.date(2024, 1, 8), dt.date(2024, 1, 1)
    listing = "product_id int, store_id int, price decimal(10,2), stock_status string, match_status string"
    now = spark.createDataFrame([(1, 1, Decimal("99.90"), "disponible", "confirmed"), (2, 1, Decimal("50"), "disponible", "confirmed"), (3, 1, Decimal("1"), "agotado", "confirmed"), (4, 1, Decimal("10"), "agotado", "confirmed"), (4, 2, Decimal("20"), "disponible", "confirmed")], listing)
    past = spark.createDataFrame([(1, before, Decimal("119.90")), (2, before, Decimal("40")), (3, before, Decimal("9")), (4, before, Decimal("15"))], "product_id int, scraped_date date, price decimal(10,2)")
    products = spark.createDataFrame([(k, f"p{k}") for k in range(1, 5)], "product_id int, name_canonical string")
    stores = spark.createDataFrame([(1, "one"), (2, "two")], "store_id int, store_name string")
    out = catalog.deals(products, now, stores, past, today, limit=5).collect()
    assert [(r.product_id, r.store_name, float(r.drop_percent)) for r in out] == [(4, "one", 33.3), (1, "one", 16.7)]
    assert catalog.page_links(41, 2, 20) == {"next": 3, "prev": 1}


def test_fan_out_plans_no_nested_loop(spark):
    e = spark.createDataFrame([(1, 5, 9)], "event_id int, product_id int, store_id int")
    s = spark.createDataFrame([("a", 5, None), ("b", 5, 9), ("c", 5, 8), ("d", 6, None)], "subscriber_id string, product_id int, store_id int")
    out = stock.fan_out(e, s)
    assert states(out, "subscriber_id") == [("a",), ("b",)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_failures(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, t0 + dt.timedelta(hours=k), k, f) for k, f in enumerate([True, True, False, True, None, True, True])], "s int, ts timestamp, id int, failed boolean")
    out = stock.failure_runs(runs, "s", "ts", "id", "failed").orderBy("id").collect()
    assert [r.failures for r in out] == [1, 2, 0, 1, 1, 2, 3]
    assert [r.backoff_until for r in out][:5] == [None] * 5 and out[6].backoff_until == t0 + dt.timedelta(hours=6, minutes=30)


def test_reviews(spark):
    li = spark.createDataFrame([(1, "needs_review", None, None), (2, "confirmed", 5, 0.7)], "id int, match_status string, product_id int, match_confidence double")
    ch = spark.createDataFrame([(1, "confirm", 5), (1, "confirm", 99), (1, "reopen", None), (2, "reject", None), (2, "reopen", None), (3, "reject", None)], "id int, action string, chosen_id int")
    pairs = spark.createDataFrame([(1, 5, 0.44)], "id int, product_id int, score double")
    products = spark.createDataFrame([(5,)], "product_id int")
    out = states(changes.apply_reviews(li, ch, pairs, products, ["id"]), "id", "action", "code", "new_status", "new_product_id", "new_confidence")
    assert sorted(out, key=repr) == sorted([(1, "confirm", 200, "confirmed", 5, 0.44), (1, "confirm", 422, "needs_review", None, None), (1, "reopen", 409, "needs_review", None, None), (2, "reject", 200, "not_applicable", None, 0.7), (2, "reopen", 200, "needs_review", None, None), (3, "reject", 404, None, None, None)], key=repr)


def test_payload_details(spark):
    texts = spark.createDataFrame([("a<b class='x'>leak", "Price 20,00 € 15,50 €", "Sin stock disponible", "Long name..."), ("plain", "none", "hmm", "fi … ne"), ("x", "none", "SOLD OUT", "cut … ")], "a string, b string, c string, d string")
    got = texts.select(payloads.clean_markup(F.col("a")).alias("a"), payloads.last_money(F.col("b")).alias("b"), payloads.stock_from_words(F.col("c")).alias("c"), payloads.looks_truncated(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("a", 15.5, "agotado", True), ("plain", None, "desconocido", False), ("x", None, "agotado", True)]
    page = '<script type="application/ld+json">{"@type":"Product","name":"x","offers":{"price":"9,5"}}</script>'
    pages = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
    assert states(payloads.json_ld(pages), "price", "stock_status") == [(9.5, "desconocido")]
    assert states(payloads.json_ld(pages, strict=True), "stock_status") == [("disponible",)]


def test_ingest_counts_drops_and_cuts(spark):
    shape = "store_id int, store_url string, raw_variant string, raw_name string, store_sku string, stock_status string"
    rows = [(1, "a", None, "n" * 501, "s" * 300, "x"), (1, "", None, "n" * 501, None, None), (1, "b", None, None, None, None), (1, "c", None, "n", None, None)]
    seen = Observation("ingest")
    assert ingest.valid_rows(spark.createDataFrame(rows, shape), seen).count() == 2
    assert seen.get == {"dropped": 2, "cut": 2}


def test_small_operators(spark):
    log = spark.createDataFrame([(1, k, f"tienda x: producto {k}/9" if k % 2 else "AVISO nada") for k in range(5)], "run int, line int, message string")
    tail = changes.log_tail(log, "run", "line", keep=2).select("line", changes.progress(F.col("message")).alias("p"))
    assert sorted((r.line, r.p and tuple(r.p)) for r in tail.collect()) == [(3, (3, 9)), (4, None)]
    assert changes.log_tail(log.limit(0), "run", "line").count() == 0
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 1, 500000),), (None,)], "t timestamp").select(times.to_unix(F.col("t")).alias("u"))
    assert [r.u for r in t.collect()] == [1704067201.5, None]
    assert [r.t for r in t.select(times.from_unix(F.col("u")).alias("t")).collect()] == [dt.datetime(2024, 1, 1, 0, 0, 1, 500000), None]
    assert sinks.camel(spark.range(1).select(F.col("id").alias("min_price"), F.lit(1).alias("name"))).columns == ["minPrice", "name"]
    with pytest.raises(RuntimeError):
        matching.need_categories(spark.createDataFrame([], "category_slug string"))
    seed = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", None, 1)], "name string, category_slug string, v int")
    have = spark.createDataFrame([("a", "x", 2)], "name string, category_slug string, v int")
    assert states(ingest.seed_actions(have, seed, ["name"], ["v"], F.col("s.category_slug") == "x"), "name", "action") == [("a", "updated"), ("b", "skipped"), ("c", "skipped")]


def test_rematched_state_leaves_confirmed_rows(spark):
    shape = "id int, match_status string, product_id int, match_confidence double"
    li = spark.createDataFrame([(1, "confirmed", 5, 0.9), (2, "needs_review", None, None), (3, "unmatched", None, 0.3)], shape)
    new = spark.createDataFrame([(2, "confirmed", 7, 0.8), (3, "needs_review", None, None)], "id int, new_status string, product_id int, score double")
    assert states(matching.rematched_state(li, new, ["id"]), "id", "match_status", "product_id", "match_confidence") == [(1, "confirmed", 5, 0.9), (2, "confirmed", 7, 0.8), (3, "needs_review", None, None)]


def test_reviews_in_a_batch(spark):
    shape = "id int, match_status string, product_id int, match_confidence double, reviewed_at timestamp, reviewed_reason string"
    li = spark.createDataFrame([(1, "needs_review", None, 0.4, None, None)], shape)
    ch = spark.createDataFrame([(1, "confirm", 5, None, 1), (1, "reject", None, "figure", 2)], "id int, action string, chosen_id int, reason string, at int")
    now = dt.datetime(2024, 1, 1)
    one = changes.latest_changes(ch, ["id"], "at")
    out = changes.apply_reviews(li, one, spark.createDataFrame([], "id int, product_id int, score double"), spark.createDataFrame([(5,)], "product_id int"), ["id"], now)
    assert states(out, "new_status", "new_reviewed_at", "new_reason", "new_confidence") == [("not_applicable", now, "figure", 0.4)]
    hidden = out.select(F.col("id"), F.col("new_reviewed_at").alias("reviewed_at"))
    assert changes.not_hidden(hidden, now + dt.timedelta(days=14)).count() == 0 and changes.not_hidden(hidden, now + dt.timedelta(days=15)).count() == 1


def test_snapshot_touch_and_api_fallback(spark):
    old = spark.createDataFrame([("a", None, 1), ("a", "v", 1)], "url string, variant string, checked int")
    assert states(ingest.touch(old, spark.createDataFrame([("a", None)], "url string, variant string"), ["url", "variant"], "checked", 9), "variant", "checked") == [("v", 1), (None, 9)]
    api = spark.createDataFrame([(1, "x", "s")], "store_id int, name string, sku string")
    html = spark.createDataFrame([(1, "y"), (2, "z")], "store_id int, name string")
    assert states(payloads.api_or_html(api, html), "store_id", "name", "sku") == [(1, "x", "s"), (2, "z", None)]
    catalog_page = spark.createDataFrame([('{"products":[{"name":"n","code":"c"},{"name":"m"}]}',), ("busy",)], "payload string")
    assert states(payloads.official_catalog(catalog_page), "name", "code") == [("m", None), ("n", "c")]
    pager = spark.createDataFrame([('<a class="x next" href="/p2">',), ('<link rel="next" href="/p3">',), ("<p>",)], "html string")
    assert {r.n for r in pager.select(payloads.next_page(F.col("html")).alias("n")).collect()} == {"/p2", "/p3", None}
    stores = spark.createDataFrame([(1, True, None), (2, True, dt.datetime(2024, 1, 2)), (3, False, None)], "id int, active boolean, backoff_until timestamp")
    assert states(stock.runnable(stores, dt.datetime(2024, 1, 1)), "id") == [(1,)]
    subs = spark.createDataFrame([("a", 1), ("b", 1)], "subscriber_id string, product_id int")
    assert states(changes.drop_subscriptions(subs, subs.filter("subscriber_id = 'a'"), "subscriber_id"), "subscriber_id") == [("b",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, scraped_date string")
    sinks.write_days(df, f"{tmp_path}/d")
    sinks.write_days(spark.createDataFrame([(3, "2024-01-02")], "v int, scraped_date string"), f"{tmp_path}/d")
    assert states(spark.read.parquet(f"{tmp_path}/d"), "v") == [(1,), (3,)]
    sinks.write_csv(df, f"{tmp_path}/c", ["v"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["v"]
    assert spark.read.parquet(sinks.write_snapshot(df, f"{tmp_path}/s")).count() == 2


def test_run_counts_of_one_moment_do_not_hang_on_order(spark):
    from pricetide.operators import runs

    at = dt.datetime(2024, 1, 1)
    rows = [("r", "daily_sweep", None, "running", at, 1, None, None, None, None), *(("r", None, "s", None, at, None, 1, n, 10 - n, 0) for n in (3, 7, 5))]
    for order in (rows, rows[::-1], [rows[0], rows[2], rows[3], rows[1]]):
        got = runs.states(spark.createDataFrame(order, runs.LOG).coalesce(1)).first()
        assert (got.rows, got.dropped, got.stores_done) == (7, 3, 1)


def test_a_year_is_written_by_several_tasks(spark, monkeypatch):
    from pricetide import report_queries
    from pricetide.catalog_queries import QUERIES

    tasks, write = [], sinks.write_days

    def spied(df, path, day):
        tasks.append(df.filter("year = 1998").select(F.spark_partition_id()).distinct().count())
        write(df, path, day)

    monkeypatch.setattr(report_queries.sinks, "write_days", spied)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        QUERIES["daily_partitions"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert min(tasks) > 2
