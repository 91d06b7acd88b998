import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricetide.operators import catalog, ingest, refresh, runs
from pricetide.sources import landed, payloads
from pricetide.streaming.restock import notify_once

AT = dt.datetime(2026, 8, 1)


def shopify(*names):
    return json.dumps({"products": [{"id": k, "title": n, "handle": f"h{k}", "images": [], "variants": [{"title": "Default Title", "price": "9,5", "available": True}]} for k, n in enumerate(names)]})


@pytest.fixture
def folder(tmp_path):
    for store, files in {"https://a": {"01": shopify("A1"), "02": shopify("A2", "A3"), "_part": shopify("no")}, "tienda é (b)": {"01": shopify("B1")}, "empty": {}}.items():
        path = tmp_path / f"landed/store={store.replace(':', '%3A').replace('/', '%2F')}"
        path.mkdir(parents=True)
        for name, text in files.items():
            (path / name).write_text(text)
    return tmp_path / "landed"


def test_landed_payloads(spark, folder):
    rows = landed.scraped(spark, str(folder), "shopify")
    assert sorted((r.store, r.file, r.name) for r in rows.collect()) == [("https://a", "01", "A1"), ("https://a", "02", "A2"), ("https://a", "02", "A3"), ("tienda é (b)", "01", "B1")]
    one = landed.scraped(spark, f"file://{folder}", "shopify", ["tienda é (b)"])
    assert [r.name for r in one.collect()] == ["B1"] and one.rdd.getNumPartitions() == 1  # other folders stay closed
    reader = landed.LandedReader({"path": str(folder)})
    left = list(reader.pushFilters([landed.EqualTo(("store",), "https://a"), landed.In(("store",), ("https://a", "x")), landed.EqualTo(("file",), "01")]))
    assert [p.store for p in reader.partitions()] == ["https://a"] and left == [landed.EqualTo(("file",), "01")]
    assert landed.scraped(spark, f"{folder}/none", "shopify").count() == 0


def test_landed_payloads_on_a_stream(spark, folder, tmp_path):
    def take():
        notify_once(landed.scraped_stream(spark, str(folder), "shopify").select("store", "name"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(200)
        return sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert take() == ["A1", "A2", "A3", "B1"]
    (folder / "store=empty/07").write_text(shopify("E7"))
    (folder / "store=https%3A%2F%2Fa/03").write_text(shopify("A4"))
    assert take() == ["A1", "A2", "A3", "A4", "B1", "E7"] == take()


def test_shopify_pages(spark):
    none = '{"products":[{"id":1,"title":"t","handle":"h","variants":[]},{"id":2,"title":"u","handle":"h"},{"id":3,"title":"v","handle":"h","variants":[{"title":"Default Title"},{"title":"EN","price":"1"}]}]}'
    rows = payloads.shopify(spark.createDataFrame([("s", none)], "store_url string, payload string")).collect()
    assert sorted((r.id_product, r.variant or "", r.stock_status, r.price) for r in rows) == [("1", "", "agotado", None), ("2", "", "agotado", None), ("3", "Default Title", "agotado", None), ("3", "EN", "agotado", 1.0)]


def test_refresh_outcomes(spark):
    good = '{"product":{"title":"T","variants":[{"title":"EN","price":"3.5","available":true},{"title":"JP","price":null}]}}'
    landed_pages = spark.createDataFrame([(1, "a", 200, good), (1, "b", 304, good), (1, "c", None, None), (1, "d", 200, '{"product":{"variants":[]}}'), (1, "e", 200, "x"), (1, "f", 200, None), (2, "a", 404, good)], "store_id int, store_url string, http_status int, payload string")
    got = sorted((r.store_id, r.store_url, r.status, r.variant or "", r.price or 0, r.stock_status or "") for r in refresh.shopify_items(landed_pages).collect())
    assert got == [(1, "a", "modified", "EN", 3.5, "disponible"), (1, "a", "modified", "JP", 0, "agotado"), (1, "b", "not_modified", "", 0, ""), (1, "c", "error", "", 0, ""), (1, "d", "error", "", 0, ""), (1, "e", "error", "", 0, ""), (1, "f", "error", "", 0, ""), (2, "a", "error", "", 0, "")]
    html = '<script type="application/ld+json">{"@type":"%s","name":"N","offers":{"price":"2"}}</script>'
    pages = spark.createDataFrame([(1, "a", 200, html % "Product"), (1, "b", 200, html % "product"), (1, "c", 304, None)], "store_id int, store_url string, http_status int, html string")
    states = lambda p: sorted((r.store_url, r.status, r.price, r.stock_status) for r in refresh.page_items(pages, p).collect())
    assert states("odoo") == [("a", "modified", 2.0, "disponible"), ("b", "error", None, None), ("c", "not_modified", None, None)]
    assert states("jsonld") == [("a", "modified", 2.0, "desconocido"), ("b", "modified", 2.0, "desconocido"), ("c", "not_modified", None, None)]
    assert {s for _, s, *_ in states("prestashop")[:2]} == {s for _, s, *_ in states("opencart")[:2]} == {"error"}


def test_products_are_classified_and_placed(spark):
    parsed = spark.createDataFrame([("A", "odoo", "Booster Box OP-16 EN", 9.5, "DISPONIBLE", "u", 7), ("A", "odoo", None, 1.0, "agotado", "v", 8), ("gone", "odoo", "x", 1.0, "agotado", "w", 9)], "store string, platform string, name string, price double, stock_status string, url string, id_product int")
    products = ingest.product_rows(parsed)
    assert products.columns == [*ingest.PRODUCT_FIELDS, "tags"]
    first = products.filter("url = 'u'").first()
    assert (first.product_type, first.set_code, first.main_set, first.language, first.variant, first.id_product) == ("ONE_PIECE", "OP16", "OP16", "EN", None, "7")
    assert products.filter("url = 'v'").first().product_type == "OTROS"
    stores = spark.createDataFrame([(3, "A"), (4, "A"), (5, "B")], "store_id int, store_name string")
    rows = ingest.accepted(ingest.scraped_rows(products, stores)).collect()
    assert [(r.store_id, r.store_url, r.raw_name, r.stock_status) for r in rows] == [(3, "u", "Booster Box OP-16 EN", "disponible")]


def test_run_log(spark, tmp_path):
    log = f"{tmp_path}/log"
    at = lambda m: AT + dt.timedelta(minutes=m)
    one = runs.begin(spark, log, "daily_sweep", stores_total=3, at=at(0))
    two = runs.begin(spark, log, "single_store", "A", at=at(1))
    rows = spark.createDataFrame([("u", "n" * 501, None, "X"), ("v", None, None, "Agotado"), (None, "n", None, "agotado")], "store_url string, raw_name string, raw_variant string, stock_status string")
    taken = []
    write = lambda df: taken.append(sorted((r.store_url, len(r.raw_name), r.stock_status) for r in df.collect()))
    assert runs.store_done(spark, log, one, "A", rows, write, at(2)) == {"rows": 3, "dropped": 2, "cut": 1}
    assert taken == [[("u", 500, "desconocido")]]
    runs.store_done(spark, log, one, "A", rows.limit(0), write, at(3))  # tried again
    runs.store_done(spark, log, one, "B", rows.filter("store_url = 'v'"), write, at(4))
    runs.finish(spark, log, one, "completed", at(5))
    states = {r.run_id: r for r in runs.states(spark.read.parquet(log)).collect()}
    r = states[one]
    assert (r.job_type, r.status, r.started_at, r.finished_at, r.stores_total, r.stores_done, r.rows, r.dropped, r.cut) == ("daily_sweep", "completed", at(0), at(5), 3, 2, 1, 1, 0)
    assert (states[two].status, states[two].finished_at, states[two].store_label, states[two].stores_done) == ("running", None, "A", 0)
    last = {r.store_label: (r.run_id, r.rows, r.at) for r in runs.last_of_stores(spark.read.parquet(log)).collect()}
    assert last == {"A": (one, 0, at(3)), "B": (one, 1, at(4))}
    for bad in (lambda: runs.begin(spark, log, "nightly"), lambda: runs.finish(spark, log, one, "running")):
        with pytest.raises(ValueError):
            bad()


def test_small_reads(spark):
    products = spark.createDataFrame([(1, "A"), (2, None)], "product_id int, name_canonical string")
    wanted = spark.createDataFrame([(2,), (3,)], "product_id int")
    assert sorted(tuple(r) for r in catalog.raw_products(products, wanted).collect()) == [(2, None, 200), (3, None, 404)]
    stores = spark.createDataFrame([(2, "B"), (1, "B"), (3, "A")], "store_id int, store_name string")
    health = spark.createDataFrame([(1, AT, 2, None)], "store_id int, last_scraped_at timestamp, consecutive_failures int, backoff_until timestamp")
    rows = catalog.detailed_stores(stores, health).orderBy("place").collect()
    assert [(r.store_id, r.consecutive_failures, r.last_scraped_at) for r in rows] == [(3, 0, None), (1, 2, AT), (2, 0, None)]
    nodes = spark.createDataFrame([(2, "b", "s"), (1, "a", "t")], "id int, name string, slug string")
    assert [(r.id, r.place) for r in catalog.flat_categories(nodes).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_feed_of_a_game(spark):
    from pricetide.operators.stock import restock_feed

    events = spark.createDataFrame([(1, AT, 1, 1), (2, AT, 2, 1), (3, AT, 1, 2)], "event_id int, detected_at timestamp, product_id int, store_id int")
    products = spark.createDataFrame([(1, "A", "g", "c"), (2, "B", "g", "d")], "product_id int, name_canonical string, game_slug string, category_slug string")
    stores = spark.createDataFrame([(1, "S"), (2, "T")], "store_id int, store_name string")
    listings = spark.createDataFrame([(1, 1, 3.5), (1, 2, None)], "store_id int, product_id int, price double")
    ids = lambda **k: sorted(r.event_id for r in restock_feed(events, products, stores, AT, 1, **k).collect())
    assert (ids(), ids(game="g"), ids(game="x"), ids(category="c"), ids(listings=listings)) == ([1, 2, 3], [1, 2, 3], [], [1, 3], [1, 2])
    assert restock_feed(events, products, stores, AT, 1, listings=listings).filter(F.col("price") == 3.5).count() == 1
