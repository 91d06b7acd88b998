import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions.prices import parse_minor_units
from pricetide.operators import crawl
from pricetide.sources import markup, payloads


@pytest.mark.parametrize(
    "html, selector, texts",
    [
        ("<ul><li class='a b'>x<ul><li>y</ul><b>z</b></li><li class=b>w</ul>", "li.a", ["xyz"]),
        ("<ul><li class='a b'>x<ul><li>y</ul><b>z</b></li><li class=b>w</ul>", "li.b.a b, li + li", ["z", "w"]),
        ("<p>one<p>two</p></p>three", "p", ["onetwo", "two"]),  # what is not closed goes on
        ("<div><i>a</div>b</i>", "div, i", ["a", "a"]),
        ("<br><img src=x><div/>t<hr>", "br, img, div", ["", "", ""]),
        ("<a rel='next' data-x='12'>1</a><a rel=nextish>2</a>", "a[rel='next'], a[rel^=nexti]", ["1", "2"]),
        ("<a href='/p/1'>1</a><a href='/q'>2</a><a>3</a>", "a[href*='/p/'], a[href$=q]", ["1", "2"]),
        ("<div class=x><p><b>1</b></p><b>2</b></div>", "div > b", ["2"]),
        ("<script>if (a<b) '<b>no</b>'</script><b>a &amp; &lt;b&gt;&nbsp;c<!-- <b>d</b> --> e </b>", "b", ["a & <b>\xa0ce"]),
        ("<B CLASS=Up>t</B>", "b.Up", ["t"]),
        ("", "b", []),
    ],
)
def test_selectors(html, selector, texts):
    page = markup.Page(html)
    assert [page.value(i, "text") for i in page.select(selector)] == texts


def test_inside_counts_from_the_whole_page():
    page = markup.Page("<div class=price><p class=card><b>1</b></p></div>")
    (card,) = page.select(".card")
    assert page.field(card, (".none", ".price b"), "text") == "1" and page.field(card, "u", "text") is None
    with pytest.raises(ValueError):
        markup.parse_selector("a:hover")


WOO = """<ul class=products><li class="product type outofstock"><a class="woocommerce-LoopProduct-link" href="/a"><h2>One <b>two</b> &lt;b class="x"&gt;leak</h2></a>
<ul><li>tag</li></ul><article>x</article><span class="price"><del><span class="amount">20,00 €</span></del> <ins><span class="amount"><bdi>1.012,95 €</bdi></span></ins></span></li>
<li class=product><h3><a href="/b?x=1&amp;y=2">B</a></h3>Agotado<span class="price">20€<span>-10%</span>18€</span><img src="" data-src="i.png"></li>
<div class="product"><h2></h2></div><div class="product"><h2>C<!-- x -->D</h2><p class=price><ins></ins>9 €</p></div></ul>"""
PRESTA = """<article class="product-miniature js" data-id-product="7"><h3 class="product-title"><a href="/p7">Name <br>x</a></h3><span class="product-price" content="12.5">99 €</span>
<ul><li><div class="product-available"></div></li></ul><span class=product-reference> R1 </span><img class="product-thumbnail-first" data-original="o.jpg"></article>
<article class="product-miniature" data-id-product="8"><article>in</article><div class="product-title"><a>q</a></div>Disponible<span class="product-price">9 €</span></article><article class="product-miniature"></article>"""
OPEN = """<div class="product-layout"><div class="product-thumb"><div class="image"><a href="/i?product_id=4"><img src=x></a></div><div class="caption"><h4><a href="/i?product_id=5">N</a></h4>
<p class="price">12,95€</p></div><button>Añadir al carrito</button></div></div><div class=product-thumb><h4><a>Sold</a></h4>Sold out, disponible</div>"""


def test_list_page_cards(spark):
    def rows(platform, html):
        got = payloads.html_cards(spark.createDataFrame([(1, html), (2, None)], "s int, html string"), platform).collect()
        return [tuple(r)[1:] for r in got]

    assert rows("woocommerce", WOO) == [(0, None, "Onetwo", "/a", 1012.95, "agotado", None, None), (1, None, "B", "/b?x=1&y=2", 18.0, "disponible", None, "i.png"), (3, None, "CD", None, None, "disponible", None, None)]
    assert rows("prestashop", PRESTA) == [(0, "7", "Namex", "/p7", 12.5, "disponible", "R1", "o.jpg"), (1, "8", "q", None, None, "agotado", None, None), (2, None, None, None, None, "agotado", None, None)]
    assert rows("opencart", OPEN) == [(0, "4", "N", "/i?product_id=4", 12.95, "desconocido", None, "x"), (1, "4", "N", "/i?product_id=4", 12.95, "desconocido", None, "x"), (2, None, "Sold", None, None, "agotado", None, None)]


def test_minor_units(spark):
    rows = [("1600", 0, 1600.0), ("1600", 3, 1.6), ("1600000000", 6, 1600.0), ("12345678901234567", 15, 12.35), ("1600", None, None), ("x", 6, None)]
    got = spark.createDataFrame(rows, "t string, u int, p double").select(parse_minor_units(F.col("t"), F.col("u")).alias("got"), "p").collect()
    assert [r.got for r in got] == [r.p for r in got]
    item = '[{"id":%d,"name":"n","prices":{"price":"1600"%s},"images":[]}]'
    pages = spark.createDataFrame([(item % (k, u),) for k, u in enumerate(["", ',"currency_minor_unit":0', ',"currency_minor_unit":3', ',"currency_minor_unit":6', ',"currency_minor_unit":null'])], "payload string")
    assert {r.id_product: r.price for r in payloads.woocommerce(pages).collect()} == {"0": 16.0, "1": 16.0, "2": 1.6, "3": 0.0, "4": 16.0}


def test_chain(spark):
    rows = [("gap", p, True) for p in (1, 2, 4)] + [("stop", p, p != 2) for p in range(1, 5)] + [("long", p, True) for p in range(1, 60)] + [("null", 1, None), ("null", 2, True), ("late", 2, True)]
    pages = spark.createDataFrame(rows, "store_id string, page int, ok boolean")
    got = {r.store_id: r.n for r in crawl.chain(pages, F.col("ok")).groupBy("store_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"gap": 2, "stop": 2, "long": 50, "null": 1}
    assert crawl.chain(pages, F.col("ok"), limit=None).filter("store_id = 'long'").count() == 59


def queue(starts, links, limit):
    """One page after the other, as a crawl with a queue goes."""
    ahead, seen = list(starts), []
    while ahead and (limit is None or len(seen) < limit):
        url = ahead.pop(0)
        if url in seen:
            continue
        seen.append(url)
        ahead += [u for u in links.get(url, []) if u not in seen and u not in ahead]
    return seen


@pytest.mark.parametrize("limit", [4, None])
def test_frontier_equals_a_queue(spark, limit):
    rng = random.Random(3)
    shops = {}
    for s in range(12):
        n = rng.randint(1, 9)
        links = {f"u{k}": [f"u{rng.randint(0, n)}" for _ in range(rng.randint(0, 4))] for k in range(n) if rng.random() < 0.9}
        shops[s] = ([f"u{rng.randint(0, n)}" for _ in range(rng.randint(1, 3))], links)
    starts = spark.createDataFrame([(s, u, k) for s, (own, _) in shops.items() for k, u in enumerate(own)], "store_id int, url string, place int")
    pages = spark.createDataFrame([(s, u, to) for s, (_, links) in shops.items() for u, to in links.items()], "store_id int, url string, links array<string>")
    got = {}
    for r in sorted(crawl.frontier(starts, pages, limit=limit).collect(), key=lambda r: r.place):
        got.setdefault(r.store_id, []).append(r.url)
    assert got == {s: queue(own, links, limit) for s, (own, links) in shops.items()}


def test_two_stages(spark):
    def grid(urls, more):
        return "".join(f"<div class=oe_product_cart><a href='{u}'>x</a></div>" for u in urls) + ("<ul class=pagination><a rel=next></a></ul>" if more else "")

    def product(name, kind="Product"):
        return f'<script type="application/ld+json">{{"@type":"{kind}","name":"{name}","offers":{{"price":"3,5","availability":"https://schema.org/Discontinued"}}}}</script>'

    pages = [(1, 1, grid(["/a", "https://x/b", "/a"], True)), (1, 2, grid(["/b", "/c"], True)), (1, 3, grid(["/c"], True)), (1, 4, grid(["/never"], False)), (2, 1, ""), (2, 2, grid(["/d"], False)), (3, 1, grid(["/e"], False)), (3, 1, None)]
    urls = crawl.grid_urls(spark.createDataFrame([(s, "https://x", p, h) for s, p, h in pages], "store_id int, base string, page int, html string"))
    assert sorted(tuple(r) for r in urls.collect()) == [(1, "https://x/a", 1), (1, "https://x/b", 1), (1, "https://x/c", 2), (3, "https://x/e", 1)]
    details = spark.createDataFrame([(1, "https://x/a", product("A")), (1, "https://x/a", None), (1, "https://x/b", product("B", "product")), (1, "https://x/never", product("N")), (3, "https://x/e", "<html>")], "store_id int, url string, html string")
    rows = crawl.with_details(urls, details, strict=True).collect()
    assert [(r.store_id, r.url, r.page, r.name, r.price, r.stock_status) for r in rows] == [(1, "https://x/a", 1, "A", 3.5, "agotado")]
    assert [r.url for r in crawl.with_details(urls, details).orderBy("url").collect()] == ["https://x/a", "https://x/b"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "store_id int, base string, url string, page int, html string")
    starts = spark.createDataFrame([(1, "u", 0)], "store_id int, url string, place int")
    assert crawl.listed_products(pages, "prestashop").count() == crawl.listed_products(pages, "opencart").count() == crawl.grid_urls(pages).count() == 0
    assert crawl.linked_products(starts, pages, "a").count() == crawl.followed_products(starts.limit(0), pages).count() == 0


def test_trails_equal_a_queue(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(crawl, "written", lambda df, name: rounds.append(name) or df.localCheckpoint())
    rng = random.Random(4)
    links = {(0, f"u{i}"): f"u{i + 1}" for i in range(200)} | {(1, f"u{i}"): f"u{rng.randrange(40)}" for i in range(30)} | {(2, "u0"): "u0"}
    starts = [(0, "u0", 0), (1, "u3", 5), (1, "u9", 2), (1, "u7", 7), (2, "u0", 0), (3, "u1", 0)]
    want = set()
    for store in range(4):
        queue = [u for s, u, p in sorted(starts, key=lambda x: x[2]) if s == store]
        for u in queue:
            if links.get((store, u)) and links[store, u] not in queue:
                queue.append(links[store, u])
        want |= {(store, u, k) for k, u in enumerate(queue, 1)}
    got = crawl.trail(spark.createDataFrame(starts, "store_id int, url string, place int"), spark.createDataFrame([(s, u, to) for (s, u), to in links.items()] + [(3, "u1", None)], "store_id int, url string, to string"))
    assert {tuple(r) for r in got.collect()} == want and len(rounds) < 25


def test_cards_read_each_page_once_on_many_tasks(spark):
    from pricetide import page_queries  # noqa: F401 (adds its queries)
    from pricetide.catalog_queries import QUERIES
    from pricetide.plans.adapters import Domain

    plan = QUERIES["woocommerce_cards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert Domain(spark, "/root/testdata/sf0.001").spread("part").rdd.getNumPartitions() >= 12


def test_plain_pages_read_as_by_the_parser():
    """What is read token by token is what the parser reads, whatever stands in a page; and list pages are."""
    import random

    class Parsed(markup.Page):
        def _plain(self, html):
            return False

    seen = ("tags", "attributes", "classes", "parents", "previous", "end", "text_begin", "text_end", "texts")
    bits = ["<div class='a b'>", "</div>", "text", "a &amp; b", "&lt", "<br/>", "<img src=a/>", "<img src='x' />", "<!-- c -->", "<!--->", "<A HREF=/p/1>", "</A>", "<script>", "</script>", "a<2", "<a href='?a&amp;b'>", "</p >", "<title>", "</title>", "<b a b=''>", "'", ">", "<a b=\xa0>", "<a b='1'c='2'>", "<svg/>"]
    pick = random.Random(7)
    for _ in range(5000):
        html = "".join(pick.choice(bits) for _ in range(pick.randint(0, 9)))
        assert [getattr(markup.Page(html), f) for f in seen] == [getattr(Parsed(html), f) for f in seen], html
    assert markup.Page("")._plain("<ul class=pagination><li class='page active'><b>1</b></li> <li><a href='#'>2 &gt;</a></li></ul>")


def test_json_ld_pages_are_read_once(spark):
    """A filter on the product must not read every page a second time."""
    rows = payloads.json_ld(spark.createDataFrame([(1, '<script type="application/ld+json">{"@type":"Product","name":"x"}</script>'), (2, None), (3, "<p>")], "id long, html string"))
    assert [r["id"] for r in rows.collect()] == [1]
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
