"""Parsers of landed payloads (JSON, HTML, XML as string columns) into listing rows.

Fetching is not done here: whatever lands the payloads does.  All parsing is in columns, so it runs
where the payloads lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import tables
from pricetide.functions.columns import contains_any, first_case, found
from pricetide.functions.prices import parse_minor_units, parse_price
from pricetide.sources import markup

_SHOPIFY = "products array<struct<id:bigint,title:string,handle:string,tags:string,images:array<struct<src:string>>,variants:array<struct<title:string,price:string,available:boolean,sku:string>>>>"
_WOO = "array<struct<id:bigint,name:string,permalink:string,sku:string,categories:array<struct<slug:string>>,prices:struct<price:string,currency_minor_unit:int>,is_in_stock:boolean,stock_status:string,images:array<struct<src:string>>>>"
_JSONLD = "struct<`@type`:string,name:string,sku:string,gtin:string,gtin8:string,gtin12:string,image:string,offers:string>"
_OFFER = "struct<price:string,lowPrice:string,availability:string,offers:string>"


def _stock(available: Column) -> Column:
    return F.when(available, "disponible").otherwise("agotado")


_VARIANTS = "array<struct<title:string,price:string,available:boolean,sku:string>>"


def shopify(df: DataFrame, base: str = "store_url", payload: str = "payload") -> DataFrame:
    """One row per variant of a product list page, one without a variant for a product that has none.  Tags
    may be a text or a list."""
    p = df.withColumn("_p", F.explode(F.from_json(payload, _SHOPIFY)["products"]))
    some = F.coalesce(F.nullif("_p.variants", F.array().cast(_VARIANTS)), F.from_json(F.lit("[{}]"), _VARIANTS))
    p = p.withColumn("_v", F.explode(some))
    listed = F.from_json("_p.tags", "array<string>")
    tags = F.when(F.col("_p.tags").startswith("["), F.array_join(listed, ", ")).otherwise(F.col("_p.tags"))
    return p.select(*df.drop(payload).columns, F.col("_p.id").cast("string").alias("id_product"), F.col("_p.title").alias("name"), F.col("_v.title").alias("variant"), tags.alias("tags"), parse_price(F.col("_v.price")).alias("price"), _stock(F.col("_v.available")).alias("stock_status"), F.concat(F.col(base), F.lit("/products/"), F.col("_p.handle")).alias("url"), F.col("_v.sku").alias("sku"), F.get("_p.images", 0)["src"].alias("image_url"))


def shopify_item(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per variant of a single product's page (``{"product": ...}``): place, variant, name, price, stock.  Pages
    without variants, or that are no such text, have no rows."""
    item = F.from_json(payload, f"product struct<title:string,variants:{_VARIANTS}>")["product"]
    p = df.withColumn("_p", item).select("*", F.posexplode("_p.variants").alias("place", "_v"))
    return p.select(*df.drop(payload).columns, "place", F.col("_v.title").alias("variant"), F.col("_p.title").alias("name"), parse_price(F.col("_v.price")).alias("price"), _stock(F.col("_v.available")).alias("stock_status"))


def woocommerce(df: DataFrame, slug: str | None = None, words: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """One row per item of an API page, in scope: one of its categories is ``slug`` and its name holds
    all words."""
    p = df.withColumn("_p", F.explode(F.from_json(payload, _WOO)))
    if slug:
        p = p.filter(F.exists("_p.categories", lambda c: F.lower(c["slug"]) == slug.lower()))
    for w in words:
        p = p.filter(F.contains(F.lower("_p.name"), F.lit(w.lower())))
    unit = F.coalesce(F.nullif(F.col("_p.prices.currency_minor_unit"), F.lit(0)), F.lit(2))  # zero is no unit given
    price = parse_minor_units(F.col("_p.prices.price"), unit)
    return p.select(*df.drop(payload).columns, F.col("_p.id").cast("string").alias("id_product"), clean_markup(F.col("_p.name")).alias("name"), price.alias("price"), _stock(F.coalesce("_p.is_in_stock", F.col("_p.stock_status") == "instock")).alias("stock_status"), F.col("_p.permalink").alias("url"), F.nullif(F.col("_p.sku"), F.lit("")).alias("sku"), F.get("_p.images", 0)["src"].alias("image_url"))


def api_or_html(api: DataFrame, html: DataFrame, store: str = "store_id") -> DataFrame:
    """Rows of the API, and those of the HTML pages for stores whose API gave none."""
    return api.unionByName(html.join(api.select(store).distinct(), store, "left_anti"), allowMissingColumns=True)


def clean_markup(c: Column) -> Column:
    """A text cut at the first tag that leaked into it; null if nothing is left."""
    cut = F.regexp_replace(c, f"(?s){tables.LEAKED_TAG}.*$", "")
    return F.when(c.rlike(tables.LEAKED_TAG), F.nullif(F.trim(cut), F.lit(""))).otherwise(c)


def looks_truncated(name: Column) -> Column:
    """Ends in an ellipsis; one elsewhere in the name means nothing."""
    return name.rlike(tables.CUT_NAME)


def _text(markup: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def page_title(html: Column) -> Column:
    """The title of a product's own page: the first product title or main heading, leaked markup cut off."""
    return clean_markup(_text(found(html, r"(?is)<(?:h1[^>]*|[a-z0-9]+[^>]*\bproduct_title\b[^>]*)>(.*?)</(?:h1|h2|div|p)>")))


def resolve_truncated(rows: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", name: str = "name") -> DataFrame:
    """``rows`` with cut names replaced by the titles of their own pages, where one is landed (a page per
    URL; of several the largest title).  Only rows with cut names meet pages."""
    titles = pages.select(F.col(url).alias("_url"), page_title(F.col(html)).alias("_title")).groupBy("_url").agg(F.max("_title").alias("_title"))
    asked = F.when(looks_truncated(F.col(name)), F.col(url))
    joined = rows.withColumn("_asked", asked).join(titles, F.col("_asked") == F.col("_url"), "left")
    return joined.withColumn(name, F.coalesce("_title", name)).select(rows.columns)


def last_money(text: Column) -> Column:
    """The last amount with a currency sign in a text: the price after a discount."""
    return parse_price(F.try_element_at(F.regexp_extract_all(text, F.lit(tables.MONEY), F.lit(0)), F.lit(-1)))


# BEGIN FIXED VALUES: how each platform's list pages mark their cards and what is in them
CARDS = {
    "woocommerce": (
        "li.product, div.product",
        {
            "classes": ("", "class"),
            "title": (".woocommerce-loop-product__title, .product-title, h2, h3", "text"),
            "link": ("a.woocommerce-LoopProduct-link, a.product-link, h2 a, h3 a", "href"),
            "amount": ((".price ins .amount", ".price ins bdi", ".price ins", ".price .amount", ".price bdi"), "text"),
            "shown": (".price", "text"),
            "image": ("img", "src|data-src"),
        },
    ),
    "prestashop": (
        "article.product-miniature",
        {
            "own_id": ("", "data-id-product"),
            "title": (("h3.product-title a", ".product-title a"), "text"),
            "link": (("h3.product-title a", ".product-title a"), "href"),
            "reference": (".product-reference", "text"),
            "amount": ("span.product-price", "content"),
            "available": (".product-available", "text"),
            "image": (("img.product-thumbnail-first", "img"), "data-original"),
        },
    ),
    "opencart": (
        "div.product-thumb, div.product-layout",
        {
            "title": (".caption h4 a, h4 a", "text"),
            "link": (".caption h4 a, h4 a, .image a", "href"),
            "shown": (".price", "text"),
            "words": ("", "words"),
            "image": (".image img, img", "src"),
        },
    ),
    "odoo": (
        ".o_wsale_product_grid_wrapper .oe_product_cart, .oe_product_cart, .o_wsale_product_grid_wrapper .oe_product, div.oe_product",
        {"link": ("a[itemprop='url'], .o_wsale_products_item_title a, a", "href")},
    ),
}
PAGERS = {
    "woocommerce": ("a.next.page-numbers", {"link": ("", "href")}),
    "prestashop": ("nav.pagination a.js-search-link", {"label": ("", "text")}),
    "opencart": ("ul.pagination a[rel='next'], .pagination a[rel='next']", {"link": ("", "href")}),
    "odoo": ("nav.o_website_sale_pager a[rel='next'], .pagination a[rel='next'], .pagination li.active + li a", {"link": ("", "href")}),
}
_SOLD_OUT = ["agotado", "sin stock", "no disponible", "out of stock", "sold out"]
_IN_STOCK = ["en stock", "in stock", "disponible"]
# END FIXED VALUES


def stock_from_words(text: Column) -> Column:
    """Stock from a card's words: what denies it counts before what states it."""
    low = F.lower(text)
    return first_case([(contains_any(low, _SOLD_OUT), F.lit("agotado")), (contains_any(low, _IN_STOCK), F.lit("disponible"))], F.lit("desconocido"))


def list_page(html: Column, platform: str) -> Column:
    """A page's ``cards`` and ``pager`` links as they stand in it, read in one go."""
    return markup.read(html, {"cards": CARDS[platform], "pager": PAGERS[platform]})


def card_rows(df: DataFrame, platform: str, cards: str = "cards") -> DataFrame:
    """A row per card of an array of ``list_page``: position, id_product, name, url, price, stock_status, sku, image_url.

    woocommerce: the price is the reduced amount, else a single amount, else the last one with a currency sign;
    sold out only by a class of the card.  prestashop: the price's ``content`` alone; available only if marked
    so.  opencart: price and stock from the card's words.  Cards without a name are left out, but for
    prestashop's, which leave the validity check to decide; so does a missing link."""
    c = df.select(*df.drop(cards).columns, F.posexplode(cards).alias("position", "_c"))
    none, title, of = F.lit(None).cast("string"), F.nullif(F.col("_c.title"), F.lit("")), lambda f: F.col(f"_c.{f}")
    if platform == "woocommerce":
        shown = F.coalesce(F.try_element_at(F.regexp_extract_all(of("shown"), F.lit(tables.MONEY), F.lit(0)), F.lit(-1)), of("shown"))
        price = parse_price(F.when(of("amount").isNotNull(), of("amount")).otherwise(shown))
        values = {"id_product": none, "name": clean_markup(title), "price": price, "stock_status": _stock(~F.coalesce(F.contains(of("classes"), F.lit("outofstock")), F.lit(False))), "sku": none}
    elif platform == "prestashop":
        values = {"id_product": of("own_id"), "name": title, "price": parse_price(of("amount")), "stock_status": _stock(of("available").isNotNull()), "sku": of("reference")}
    else:
        values = {"id_product": found(of("link"), r"product_id=(\d+)"), "name": title, "price": parse_price(of("shown")), "stock_status": stock_from_words(of("words")), "sku": none}
    rows = c.select(*df.drop(cards).columns, "position", *(v.alias(k) for k, v in values.items()), of("link").alias("url"), of("image").alias("image_url"))
    rows = rows.select(*df.drop(cards).columns, "position", "id_product", "name", "url", "price", "stock_status", "sku", "image_url")
    return rows if platform == "prestashop" else rows.filter("name is not null")


def html_cards(df: DataFrame, platform: str, html: str = "html") -> DataFrame:
    """A row per product card of list pages, see ``card_rows``."""
    return card_rows(df.select(*df.drop(html).columns, markup.read(F.col(html), {"cards": CARDS[platform]})["cards"].alias("cards")), platform)


def next_page(html: Column) -> Column:
    """The pager's link to the next page, null on the last one."""
    return F.coalesce(found(html, r"(?i)<a[^>]*class=\"[^\"]*next[^\"]*\"[^>]*href=\"([^\"]+)\""), found(html, r"(?i)<a[^>]*rel=\"next\"[^>]*href=\"([^\"]+)\""), found(html, r"(?i)<link[^>]*rel=\"next\"[^>]*href=\"([^\"]+)\""))


def _listed(c: Column, kind: str) -> Column:
    """A JSON text as an array: a list's entries, or the one object."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{kind}>")).otherwise(F.array(F.from_json(c, kind)))


def availability(c: Column, missing: str) -> Column:
    """Stock from a schema.org availability: only these two words deny it, any other one means it can be had."""
    low = F.nullif(F.lower(c), F.lit(""))
    return first_case([(low.isNull(), F.lit(missing)), (contains_any(low, ["outofstock", "discontinued"]), F.lit("agotado"))], F.lit("disponible"))


def json_ld(df: DataFrame, html: str = "html", strict: bool = False) -> DataFrame:
    """Product data of pages with a JSON-LD product (the first one, alone or in a list); pages without
    one are left out.

    ``strict``: the type must be exactly Product, the first offer alone counts, and a missing
    availability means in stock.  Else the type's case does not matter; an offer nested in the first
    one gives price and availability where that has none, ``lowPrice`` stands in for the price, a span
    of class availability or a meta tag for the availability; and if all are missing it is unknown."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    entries = F.flatten(F.transform(scripts, lambda s: F.coalesce(_listed(s, _JSONLD), F.array().cast(f"array<{_JSONLD}>"))))
    kind = (lambda x: x["@type"] == "Product") if strict else (lambda x: F.lower(x["@type"]) == "product")
    # a generator, as a filter on a plain column would be put before it and read every page a second time
    d = df.withColumn("_p", F.explode_outer(F.slice(F.filter(entries, lambda x: F.coalesce(kind(x), F.lit(False))), 1, 1))).filter("_p is not null")
    d = d.withColumn("_o", F.get(_listed(F.col("_p.offers"), _OFFER), 0))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    if strict:
        price, seen, code = some("_o.price"), F.col("_o.availability"), F.coalesce(some("_p.gtin"), some("_p.sku"))
    else:
        d = d.withColumn("_i", F.get(_listed(F.col("_o.offers"), _OFFER), 0))
        price = F.coalesce(some("_o.price"), some("_i.price"), some("_o.lowPrice"))
        page, span = F.col(html), r"(?is)<span[^>]*class=\"(?:[^\"]*\s)?availability(?:\s[^\"]*)?\"[^>]*>(.*?)</span>"
        meta = F.coalesce(found(page, r"(?is)<meta[^>]*property=\"product:availability\"[^>]*content=\"([^\"]*)\""), found(page, r"(?is)<meta[^>]*content=\"([^\"]*)\"[^>]*property=\"product:availability\""))
        beside = F.when(page.rlike(span), _text(found(page, span))).otherwise(F.replace(meta, F.lit(" "), F.lit("")))
        seen = F.coalesce(some("_o.availability"), some("_i.availability"), beside)
        code = F.coalesce(some("_p.sku"), some("_p.gtin"), some("_p.gtin8"), some("_p.gtin12"))
    return d.select(*df.drop(html).columns, F.trim("_p.name").alias("name"), code.alias("sku"), parse_price(price).alias("price"), availability(seen, "disponible" if strict else "desconocido").alias("stock_status"), F.col("_p.image").alias("image_url"))


def prestashop_detail(df: DataFrame, html: str = "html") -> DataFrame:
    """Name, price and stock of product pages with microdata; pages without a price in it are left out."""
    page = F.col(html)
    tag = lambda p: found(page, rf"(?is)(<[^>]*itemprop=[\"']?{p}[\"'\s>][^>]*>?[^<]*)")
    attribute = lambda t, a: found(t, rf"(?is){a}=[\"']([^\"']*)[\"']")
    d = df.withColumn("_price", tag("price")).withColumn("_seen", tag("availability")).filter("_price is not null")
    seen = F.coalesce(attribute(F.col("_seen"), "href"), _text(F.col("_seen")))
    stock = F.when(F.coalesce(seen, F.lit("")) != "", availability(seen, "desconocido")).when(page.rlike(r"(?is)class=\"(?:[^\"]*\s)?product-available[\s\"]"), "disponible").otherwise("desconocido")
    return d.select(*df.drop(html).columns, _text(found(page, r"(?is)<h1[^>]*>(.*?)</h1>")).alias("name"), parse_price(F.coalesce(attribute(F.col("_price"), "content"), _text(F.col("_price")))).alias("price"), stock.alias("stock_status"))


def opencart_detail(df: DataFrame, html: str = "html") -> DataFrame:
    """Name and last price of product pages; stock is never guessed there.  Pages without a price are left
    out.  The price's element is read up to its closing list, paragraph or division."""
    page = F.col(html)
    d = df.withColumn("_price", _text(found(page, r"(?is)class=\"(?:[^\"]*\s)?price(?:\s[^\"]*)?\"[^>]*>(.*?)</(?:p|div|ul|h[1-6])>"))).filter("_price is not null")
    name = F.regexp_replace(_text(found(page, r"(?is)<h1[^>]*>(.*?)</h1>")), r"(?i)^Clic para ampliar\s*", "")
    return d.select(*df.drop(html).columns, name.alias("name"), F.coalesce(last_money(F.col("_price")), parse_price(F.col("_price"))).alias("price"), F.lit("desconocido").alias("stock_status"))


def sitemap(df: DataFrame, xml: str = "xml", only_products: bool = False) -> DataFrame:
    """(…, loc): every location of a sitemap; of an index, only sub-maps for products."""
    locs = df.withColumn("loc", F.explode(F.xpath(F.col(xml), F.lit('//*[local-name()="loc"]/text()'))))
    return (locs.filter(F.contains(F.lower("loc"), F.lit("product"))) if only_products else locs).drop(xml)


def official_catalog(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(name, code) of the publisher's product list."""
    return df.select(F.explode(F.from_json(payload, "products array<struct<name:string,code:string>>")["products"]).alias("p")).select("p.name", "p.code")


def page_number(url: Column) -> Column:
    return found(url, r"[?&/]page[=/](\d+)").try_cast("int")
