"""Registered queries over list pages and crawls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.catalog_queries import query
from pricetide.operators import crawl
from pricetide.plans.adapters import Domain
from pricetide.sources import payloads


def _page(df: DataFrame, keys: list[str], card: Column, order: str) -> DataFrame:
    """Cards of each group in a row."""
    cards = F.array_sort(F.collect_list(F.struct(order, card.alias("card"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(cards, lambda c: c["card"]), "\n").alias("cards"))


def _html(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""select p_partkey as id, p_name as name, case when p_partkey % 4 = 0 then null else cast(p_size as double) + 0.5 end as price,
  case when p_size % 3 = 0 then 'agotado' else 'disponible' end as stock_status, case when p_partkey % 5 = 0 then '/i/' || p_partkey else '/p/' || p_partkey end as url,
  case when p_partkey % 2 = 0 then 's' || p_partkey end as image_url from part""")
def woocommerce_cards(d: Domain) -> DataFrame:
    """Cards with lists inside, prices in five shapes, links before and in titles, unclosed items."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    tags = "<ul class=meta><li>tag</li><li>EN</ul>"
    price = F.when(n % 4 == 0, "<em>20,00 €</em>").when(n % 4 == 1, _html('<p class="price"><del><bdi>99,00 €</bdi></del><ins><bdi>', size, ",50&nbsp;€</bdi></ins></p>"))
    price = price.when(n % 4 == 2, _html("<span class='big price'>99,00€<i>-10%</i>", size, ",50€</span>")).otherwise(_html("<div class=price>desde <span class=amount>", size, ".50</span> 1 €</div>"))
    image = F.when(n % 2 == 0, _html("<img data-src=s", n, ">")).otherwise("<img alt=''>")
    link = F.when(n % 5 == 0, _html("<a class='product-link x' href='/i/", n, "'>")).otherwise("<a href='/cart'>")
    sold = F.when(F.col("p_size") % 3 == 0, " outofstock").otherwise("")
    title = _html("<h2><a href=/p/", n, ">", F.col("p_name"), "</a> &lt;b class=&quot;y&quot;&gt;rest</h2>")
    shape = F.when(n % 3 == 0, _html("<div class='post product", sold, "'>", link, image, "</a>", tags, title, price, "</div>")).otherwise(_html("<li class='product", sold, "'>", tags, link, image, "</a>", title, price, "</li><!-- <li class=product> -->"))
    rows = payloads.html_cards(d.spread("part").select(n.alias("id"), _html("<ul>", shape, "<li class=productos><h2>x</h2></li></ul>").alias("html")), "woocommerce")
    return rows.select("id", "name", "price", "stock_status", "url", "image_url")


@query("""select p_partkey as id, case when p_partkey % 3 <> 0 then 'A' || p_partkey end as id_product, case when p_partkey % 7 <> 0 then p_name end as name, case when p_partkey % 4 <> 0 then cast(p_size as double) + 0.25 end as price,
  case when p_size % 2 = 0 then 'disponible' else 'agotado' end as stock_status, case when p_partkey % 7 <> 0 then '/p/' || p_partkey end as url, case when p_partkey % 5 = 0 then 'R-' || p_partkey end as sku from part""")
def prestashop_cards(d: Domain) -> DataFrame:
    n = F.col("p_partkey")
    own = F.when(n % 3 != 0, _html(" data-id-product='A", n, "'")).otherwise("")
    title = F.when(n % 7 != 0, _html("<div class='product-title'><h3 class='product-title'><a href='/p/", n, "'>", F.col("p_name"), "<span></span></a></h3></div>")).otherwise("<h3 class=product-title>none</h3>")
    price = F.when(n % 4 != 0, _html("<span class='product-price new' content='", F.col("p_size"), ".25'>7 €</span>")).otherwise("<span class=product-price>8,00 €</span>")
    seen = F.when(F.col("p_size") % 2 == 0, "<ul><li><span class='product-available'></span></li></ul>").otherwise("<ul><li>Disponible</li></ul>")
    reference = F.when(n % 5 == 0, _html("<p class=product-reference> R-", n, " </p>")).otherwise("")
    card = _html("<article class='js product-miniature'", own, "><div><article>inner</article>", seen, title, reference, price, "</div></article>")
    rows = payloads.html_cards(d.spread("part").select(n.alias("id"), card.alias("html")), "prestashop")
    return rows.select("id", "id_product", "name", "price", "stock_status", "url", "sku")


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then cast(p_partkey as varchar) end as id_product, p_name as name, case when p_partkey % 2 = 0 then cast(p_size as double) + 0.95 end as price,
  case p_size % 4 when 0 then 'agotado' when 1 then 'disponible' when 2 then 'agotado' else 'desconocido' end as stock_status from part""")
def opencart_cards(d: Domain) -> DataFrame:
    """Words decide the stock; a button that puts into the cart says nothing."""
    n, kind = F.col("p_partkey"), F.col("p_size") % 4
    words = F.when(kind == 0, "Sin <b>stock</b>").when(kind == 1, "EN STOCK").when(kind == 2, "no disponible").otherwise("<button>Añadir al carrito</button>")
    link = F.when(n % 3 == 0, _html("?product_id=", n, "&amp;x=1")).otherwise(_html("/item/", n))
    price = F.when(n % 2 == 0, _html("<p class=price>", F.col("p_size"), ",95 €</p>")).otherwise("<p class=price><s>9,00 €</s>8,00 €</p>")
    card = _html("<div class='col product-thumb'><div class=caption><h4><a href='", link, "'>", F.col("p_name"), "</a></h4><div><div>", words, "</div></div>", price, "</div></div><div class=product-thumb><h4></h4></div>")
    rows = payloads.html_cards(d.spread("part").select(n.alias("id"), card.alias("html")), "opencart")
    return rows.select("id", "id_product", "name", "price", "stock_status")


_GRID = """, offer as (select distinct l_suppkey as store_id, l_partkey as n from lineitem), numbered as (select *, (row_number() over (partition by store_id order by n) - 1) // 10 + 1 as page from offer),
pg as (select store_id, page, list('/p/' || n) as urls, max(page) over (partition by store_id) as last from numbered group by 1, 2),
more as (select store_id, page, urls, page < last or store_id % 3 = 0 as has_next from pg union all select store_id, last + k, urls, true from pg, range(1, 4) r(k) where page = last and store_id % 3 = 0),
landed as (select * from more where not (store_id % 5 = 0 and page = 7)),
"""


@query(f"""{_GRID} reached as (with recursive r as (
  select store_id, page, urls, has_next, []::varchar[] as seen from landed where page = 1
  union all select l.store_id, l.page, l.urls, l.has_next, list_concat(r.seen, r.urls) from r join landed l on l.store_id = r.store_id and l.page = r.page + 1
  where r.has_next and r.page < 50 and len(list_filter(r.urls, lambda u: not list_contains(r.seen, u))) > 0)
  select * from r),
wanted as (select distinct store_id, unnest(urls) as path from reached)
select store_id, path, p_name as name, cast(p_size as double) + 0.5 as price, case when p_size % 4 = 0 then 'agotado' else 'disponible' end as stock_status
from wanted join part on path = '/p/' || p_partkey where p_partkey % 7 <> 0 and (p_partkey + store_id) % 11 <> 0""")
def odoo_two_stages(d: Domain) -> DataFrame:
    """Grids of ten products a page, some with a gap, some that serve their last page again for ever; then each product's own page."""
    offers = d.raw("lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("n")).distinct()
    n = F.col("n")
    card = _html("<div class='", F.when(n % 2 == 0, "oe_product").otherwise("oe_product_cart x"), "'><a href='", F.when(n % 3 == 0, "/p/").otherwise(_html("https://shop", F.col("store_id"), "/p/")), n, "'>x</a><a href='/no'>y</a></div>")
    ranked = offers.withColumn("page", F.floor((F.expr("row_number() over (partition by store_id order by n)") - 1) / 10).cast("int") + 1)
    pages = _page(ranked, ["store_id", "page"], card, "n").withColumn("last", F.expr("max(page) over (partition by store_id)"))
    again = F.when((F.col("page") == F.col("last")) & (F.col("store_id") % 3 == 0), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    pages = pages.withColumn("k", F.explode(again))
    following = (F.col("page") < F.col("last")) | (F.col("store_id") % 3 == 0)
    pager = F.when(~following, "<ul class=pagination><li><a>1</a></li><li class=active><a>2</a></li></ul>").when(F.col("store_id") % 2 == 0, "<nav class=o_website_sale_pager><a rel=next href='#'>2</a></nav>").otherwise("<ul class=pagination><li class='page active'><b>1</b></li> <li><a href='#'>2</a></li></ul>")
    pages = pages.select("store_id", (F.col("page") + F.col("k")).alias("page"), _html("https://shop", F.col("store_id")).alias("base"), _html("<body><div class='oe_product_cart'><b>no link</b></div>", F.col("cards"), pager, "</body>").alias("html"))
    pages = pages.filter(~((F.col("store_id") % 5 == 0) & (F.col("page") == 7)))
    part = d.raw("part").withColumnRenamed("p_partkey", "n")
    stock = F.when(F.col("p_size") % 4 == 0, "https://schema.org/OutOfStock").when(F.col("p_size") % 4 == 1, "").otherwise("http://schema.org/PreOrder")
    product = _html('{"@type":"', F.when(n % 7 == 0, "product").otherwise("Product"), '","name":"', F.col("p_name"), '","offers":[{"price":"', F.col("p_size"), ',50","availability":"', stock, '"}]}')
    details = offers.filter((n + F.col("store_id")) % 11 != 0).join(part, "n").select("store_id", _html("https://shop", F.col("store_id"), "/p/", n).alias("url"), _html('<script type="application/ld+json">[{"@type":"Organization"},', product, "]</script>").alias("html"))
    rows = crawl.with_details(crawl.grid_urls(pages), details, strict=True)
    return rows.select("store_id", F.regexp_replace("url", "^https://shop[0-9]+", "").alias("path"), "name", "price", "stock_status")


_CUSTOMERS = """, numbered as (select c_nationkey as store_id, c_custkey as n, c_name as name, row_number() over (partition by c_nationkey order by c_custkey) - 1 as k from customer),
"""


@query(f"""{_CUSTOMERS} cards as (select store_id, n, name, k // 4 + 1 as page, k % 4 + 1 as slot from numbered union all select store_id, n, name, k // 4 + 2, 0 from numbered where k % 4 = 3),
pages as (select store_id, page, list(case when n % 13 <> 0 then n end order by slot) as ids from cards group by 1, 2), ends as (select store_id, max(page) as last from pages group by 1),
landed as (select *, case when store_id % 4 = 0 then 9 else last end as most from pages join ends using (store_id)),
reached as (with recursive r as (
  select store_id, page, ids, most, []::bigint[] as seen from landed where page = 1
  union all select l.store_id, l.page, l.ids, l.most, list_concat(r.seen, r.ids) from r join landed l on l.store_id = r.store_id and l.page = r.page + 1
  where r.page < r.most and r.page < 50 and len(list_filter(r.ids, lambda i: i is null or not list_contains(r.seen, i))) > 0) select store_id, page from r)
select store_id, n, min(page) as page, name from cards join reached using (store_id, page) where n % 13 <> 0 group by all
union all select store_id, n, page, name from cards join reached using (store_id, page) where n % 13 = 0""")
def prestashop_pages(d: Domain) -> DataFrame:
    """Each page repeats the last card of the one before; some shops name a last page below the real one."""
    c = d.raw("customer").select(F.col("c_nationkey").alias("store_id"), F.col("c_custkey").alias("n"), F.col("c_name").alias("name"))
    c = c.withColumn("k", F.expr("row_number() over (partition by store_id order by n)") - 1)
    places = F.when(F.col("k") % 4 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = c.withColumn("again", F.explode(places)).withColumn("page", (F.floor(F.col("k") / 4) + 1 + F.col("again")).cast("int")).withColumn("at", F.when(F.col("again") == 1, F.lit(0)).otherwise(F.col("k") % 4 + 1))
    own = F.when(F.col("n") % 13 != 0, _html(" data-id-product=", F.col("n"))).otherwise("")
    card = _html("<article class=product-miniature", own, "><h3 class=product-title><a href='/", F.col("n"), "'>", F.col("name"), "</a></h3></article>")
    pages = _page(c, ["store_id", "page"], card, "at").withColumn("last", F.when(F.col("store_id") % 4 == 0, F.lit(9)).otherwise(F.expr("max(page) over (partition by store_id)")))
    html = _html(F.col("cards"), "<nav class=pagination><a class=js-search-link>1</a><a class=js-search-link> ", F.col("last"), " </a><a class=js-search-link>Siguiente</a></nav>")
    rows = crawl.listed_products(pages.select("store_id", "page", html.alias("html")), "prestashop")
    return rows.select("store_id", F.regexp_replace("url", "/", "").cast("long").alias("n"), F.col("page").cast("long").alias("page"), "name")


@query(f"""{_CUSTOMERS} cards as (select store_id, n, name, k // 6 + 1 as page from numbered), ends as (select store_id, max(page) as last from cards group by 1),
pages as (select store_id, page, page < last and not (store_id % 4 = 1 and page = 3) as has_next from (select distinct store_id, page from cards) join ends using (store_id) where not (store_id % 4 = 2 and page = 2)),
reached as (with recursive r as (select store_id, page, has_next from pages where page = 1 union all select p.store_id, p.page, p.has_next from r join pages p on p.store_id = r.store_id and p.page = r.page + 1 where r.has_next) select * from r)
select store_id, n, page, name from cards join reached using (store_id, page)""")
def opencart_pages(d: Domain) -> DataFrame:
    c = d.raw("customer").select(F.col("c_nationkey").alias("store_id"), F.col("c_custkey").alias("n"), F.col("c_name").alias("name"))
    c = c.withColumn("page", F.floor((F.expr("row_number() over (partition by store_id order by n)") - 1) / 6).cast("int") + 1)
    card = _html("<div class=product-layout><h4><a href='?product_id=", F.col("n"), "'>", F.col("name"), "</a></h4></div>")
    pages = _page(c, ["store_id", "page"], card, "n").withColumn("last", F.expr("max(page) over (partition by store_id)"))
    following = (F.col("page") < F.col("last")) & ~((F.col("store_id") % 4 == 1) & (F.col("page") == 3))
    html = _html(F.col("cards"), "<ul class=pagination><li><a href=x>1</a>", F.when(following, "<li><a rel=next href=y>&gt;</a>").otherwise(""), "</ul>")
    pages = pages.filter(~((F.col("store_id") % 4 == 2) & (F.col("page") == 2))).select("store_id", "page", html.alias("html"))
    rows = crawl.listed_products(pages, "opencart")
    return rows.select("store_id", F.col("id_product").cast("long").alias("n"), F.col("page").cast("long").alias("page"), "name")


@query("""select s_nationkey as store_id, s_name as name from (select *, (row_number() over (partition by s_nationkey order by s_suppkey) - 1) // 8 as page from supplier)
where (s_nationkey % 3 <> 1 or page < 2) and contains(lower(s_name), '1')""")
def woocommerce_pages(d: Domain) -> DataFrame:
    """Pages that link to the next by whatever address, the last one to itself; some break off after two."""
    s = d.raw("supplier").select(F.col("s_nationkey").alias("store_id"), F.col("s_suppkey").alias("n"), F.col("s_name").alias("name"))
    s = s.withColumn("page", F.floor((F.expr("row_number() over (partition by store_id order by n)") - 1) / 8).cast("int"))
    base = _html("https://shop", F.col("store_id"))
    at = lambda page: _html(base, F.when(F.col("store_id") % 2 == 0, "/c?product-page=").otherwise("/c/page/"), page)
    pages = _page(s, ["store_id", "page"], _html("<li class=product><h2>", F.col("name"), "</h2></li>"), "n").withColumn("last", F.expr("max(page) over (partition by store_id)"))
    following = at(F.least(F.col("page") + 1, F.col("last")))
    link = F.when(F.col("page") % 2 == 0, F.regexp_replace(following, "^https://shop[0-9]+", "")).otherwise(following)
    next_link = F.when((F.col("store_id") % 3 == 1) & (F.col("page") == 1), "<a class='page-numbers'>").otherwise(_html("<a class='next page-numbers' href='", link, "'>"))
    pages = pages.select("store_id", base.alias("base"), at(F.col("page")).alias("url"), _html("<ul>", F.col("cards"), "</ul>", next_link).alias("html"))
    starts = s.select("store_id", at(F.lit(0)).alias("url"), F.lit(0).alias("place")).distinct()
    return crawl.followed_products(starts, pages, ("1",)).select("store_id", "name")


@query("""
, graph as (select n_nationkey as store_id, i, i as page, [x for x in [2 * i, 2 * i + 1, i // 2] if x between 1 and 70] as links from nation, range(1, 71) r(i) where i % 11 <> 5 or n_nationkey % 2 = 0),
visited as (with recursive r as (
  select n_nationkey as store_id, [1]::bigint[] as q, [1]::bigint[] as seen, []::bigint[] as done from nation
  union all
  select store_id, list_concat(q[2:], fresh), list_concat(seen, fresh), list_append(done, q[1]) from (
    select r.*, case when g.links is null then []::bigint[] else list_filter(g.links, lambda x: not list_contains(r.seen, x)) end as fresh
    from r left join graph g on g.store_id = r.store_id and g.page = r.q[1] where len(q) > 0 and len(done) < 50))
  select store_id, done from r qualify row_number() over (partition by store_id order by len(done) desc) = 1),
pages as (select store_id, unnest(done) as page, generate_subscripts(done, 1) as place from visited)
select p.store_id, '/p/' || c_custkey as path, min(place) as page from pages p join graph g using (store_id, page) join customer c on c_nationkey = p.store_id and (c_custkey % 70 + 1 = page or c_custkey % 35 + 1 = page) group by 1, 2""")
def jsonld_frontier(d: Domain) -> DataFrame:
    """List pages whose links form a graph with ways back, gaps and more pages than a crawl may visit."""
    shops = d.raw("nation").select(F.col("n_nationkey").alias("store_id"), F.explode(F.sequence(F.lit(1), F.lit(70))).alias("i"))
    base = _html("https://shop", F.col("store_id"))
    link = lambda k, shape: F.when((k >= 1) & (k <= 70), _html(shape, F.when(k % 2 == 0, "/list/").otherwise(_html(base, "/list/")), k.cast("string"), "'>x</a>")).otherwise("<a rel=next href='#'>x</a>")
    i = F.col("i")
    pager = _html("<div class=pagination>", link(2 * i, "<a href='"), "</div>", link(2 * i + 1, "<a class=page-numbers href='"), link(F.floor(i / 2).cast("int"), "<a rel=next href='"), link(2 * i + 1, "<a rel='next' href='"))
    c = d.raw("customer").select(F.col("c_nationkey").alias("store_id"), F.col("c_custkey").alias("n"))
    on = c.withColumn("i", F.explode(F.array((F.col("n") % 70 + 1).cast("int"), (F.col("n") % 35 + 1).cast("int")))).distinct()
    cards = _page(on, ["store_id", "i"], _html("<a class=item href='", F.when(F.col("n") % 2 == 0, "").otherwise(base), "/p/", F.col("n"), "'>x</a>"), "n")
    pages = shops.filter((i % 11 != 5) | (F.col("store_id") % 2 == 0)).join(cards, ["store_id", "i"], "left")
    pages = pages.select("store_id", base.alias("base"), _html(base, "/list/", i).alias("url"), _html(F.coalesce("cards", F.lit("")), pager).alias("html"))
    starts = shops.filter("i = 1").select("store_id", _html(base, "/list/1").alias("url"), F.lit(0).alias("place"))
    rows = crawl.linked_products(starts, pages, "a.item[href*='/p/']")
    return rows.select("store_id", F.regexp_replace("url", "^https://shop[0-9]+", "").alias("path"), F.col("page").cast("long").alias("page"))
