"""What a crawl takes from landed list pages: the pages it gets to, and their products.

Fetching is not done here; whatever lands the pages does.  These operators say which landed pages count: those that
a crawl starting at a shop's first page reaches before it stops.  A page is parsed once, however often
it is asked for, and steps in between hold links, not pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.sources import markup, payloads
from pricetide.sources.storage import written

# BEGIN FIXED VALUES: list pages of a shop at most, and links that lead to further ones
MAX_PAGES = 50
PAGE_LINKS = "a[rel='next'], .pagination a, .paginacion a, .page-numbers"
# END FIXED VALUES


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands, or behind the shop's address if it is none with a scheme."""
    return F.when(link.startswith("http"), link).otherwise(F.concat(base, link))


def chain(pages: DataFrame, more: Column, store: str = "store_id", page: str = "page", limit: int | None = MAX_PAGES) -> DataFrame:
    """The numbered pages that are reached: from 1 on without a gap, while ``more`` held on each one before.

    A window over the page numbers of a shop, so no step by step; one row per page."""
    wanted = pages.filter(F.col(page) >= 1 if limit is None else F.col(page).between(1, limit)).withColumn("_more", F.coalesce(more, F.lit(False)))
    own = Window.partitionBy(store).orderBy(page)
    going = F.coalesce(F.min("_more").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    reached = wanted.withColumn("_going", going).withColumn("_n", F.row_number().over(own))
    return reached.filter(F.col("_going") & (F.col("_n") == F.col(page))).drop("_more", "_going", "_n")


def _parsed(pages: DataFrame, platform: str, store: str, page: str, html: str) -> DataFrame:
    """(store, page, cards, pager); of a page that landed several times the greatest content."""
    read = pages.select(store, page, payloads.list_page(F.col(html), platform).alias("_p"))
    return written(read.groupBy(store, page).agg(F.max("_p").alias("_p")).select(store, page, "_p.cards", "_p.pager"), "pages")


def listed_products(pages: DataFrame, platform: str, store: str = "store_id", page: str = "page", html: str = "html") -> DataFrame:
    """The cards of numbered list pages that a crawl of ``prestashop`` or ``opencart`` shops reads.

    prestashop: an id counts once, at its first place; cards without an id always count.  It goes on up to the greatest number
    among the pager's links of the page at hand, for at most ``MAX_PAGES`` pages, and stops at a page
    of which no card is new.  opencart: it goes on while a page has cards and a link to the next one."""
    parsed = _parsed(pages, platform, store, page, html)
    cards = payloads.card_rows(parsed.select(store, page, "cards"), platform)
    counts = cards.groupBy(store, page).agg(F.count("*").alias("n"))
    if platform == "prestashop":
        first = cards.filter("id_product is not null").groupBy(store, "id_product").agg(F.min(F.struct(page, "position")).alias("_first"))
        cards = cards.join(first, [store, "id_product"], "left").filter(F.col("_first").isNull() | (F.col("_first") == F.struct(page, "position"))).select(cards.columns)
        counts = counts.join(cards.groupBy(store, page).agg(F.count("*").alias("new")), [store, page], "left")
        last = F.array_max(F.transform(F.filter("pager", lambda a: a["label"].rlike(r"^\d+$")), lambda a: a["label"].try_cast("int")))
        more, limit = (F.col("n").isNull() | (F.coalesce("new", F.lit(0)) > 0)) & (F.col(page) < F.coalesce(last, F.lit(1))), MAX_PAGES
    else:
        more, limit = F.col("n").isNotNull() & (F.size("pager") > 0), None
    reached = chain(parsed.join(counts, [store, page], "left"), more, store, page, limit)
    return cards.join(reached.select(store, page), [store, page], "left_semi")


def grid_urls(pages: DataFrame, base: str = "base", store: str = "store_id", page: str = "page", html: str = "html") -> DataFrame:
    """(store, url, page) of the products in numbered odoo grids: each absolute URL once, at its first page.

    It goes on while a page holds a new URL and points to a next one, for at most ``MAX_PAGES`` pages."""
    parsed = _parsed(pages.filter(F.col(page) <= MAX_PAGES), "odoo", store, page, html)  # ``chain`` takes none beyond
    bases = pages.groupBy(store).agg(F.min(base).alias("_base"))
    links = parsed.select(store, page, F.explode("cards.link").alias("_link")).filter("_link is not null").join(bases, store)
    first = links.groupBy(store, absolute(F.col("_link"), F.col("_base")).alias("url")).agg(F.min(page).alias(page))
    new = first.groupBy(store, page).agg(F.count("*").alias("new"))
    reached = chain(parsed.select(store, page, "pager").join(new, [store, page], "left"), F.col("new").isNotNull() & (F.size("pager") > 0), store, page)
    return first.join(reached.select(store, page), [store, page], "left_semi").select(store, "url", page)


def frontier(starts: DataFrame, pages: DataFrame, store: str = "store_id", limit: int | None = MAX_PAGES) -> DataFrame:
    """(store, url, place): list pages in the order in which a crawl that keeps a queue visits them.

    ``starts``: store, url, place.  ``pages``: store, url, links (absolute, in order), one row per page.  A page
    that did not land is visited, but leads nowhere.  All pages of one distance from the start are one step: they are ranked
    by the place of the page that names them first and the link's own, pages already visited are dropped by an
    anti join, and a shop that has ``limit`` pages takes no more."""
    own = Window.partitionBy(store).orderBy("_order")
    ahead = starts.groupBy(store, "url").agg(F.min(F.struct(F.col("place").cast("long").alias("a"), F.lit(0).alias("b"))).alias("_order"))
    visited: DataFrame | None = None
    while True:
        counted = None if visited is None else visited.groupBy(store).agg(F.count("*").alias("_seen"))
        step = ahead.withColumn("_seen", F.lit(0).cast("long")) if counted is None else ahead.join(counted, store)
        step = step.withColumn("place", F.col("_seen") + F.row_number().over(own)).select(store, "url", "place")
        step = written(step if limit is None else step.filter(F.col("place") <= limit), "frontier")
        if step.isEmpty():
            return step if visited is None else visited
        visited = step if visited is None else visited.unionByName(step)
        named = step.join(pages.select(store, "url", F.posexplode("links").alias("b", "_next")), [store, "url"])
        ahead = named.groupBy(store, F.col("_next").alias("url")).agg(F.min(F.struct(F.col("place").alias("a"), "b")).alias("_order")).join(visited, [store, "url"], "left_anti")


def trail(starts: DataFrame, links: DataFrame, store: str = "store_id") -> DataFrame:
    """(store, url, place): as ``frontier`` without a limit, where a page (store, url) has one link (``to``) at most.

    Each round jumps twice as far as the one before, so a trail of n pages takes log n rounds.  A page keeps its least
    distance from a start and the first start at that distance, which is its place in the queue."""
    first = F.row_number().over(Window.partitionBy(store).orderBy("place", "url"))
    at = F.struct(F.lit(0).cast("long").alias("far"), first.alias("first")).alias("_at")
    reached = written(starts.groupBy(store, "url").agg(F.min("place").alias("place")).select(store, "url", at), "trail")
    jumps, step, known = written(links.filter("to is not null").select(store, "url", "to"), "jumps"), 1, reached.count()
    while True:
        farther = F.struct((F.col("_at.far") + step).alias("far"), F.col("_at.first").alias("first")).alias("_at")
        ahead = reached.join(jumps, [store, "url"]).select(store, F.col("to").alias("url"), farther)
        reached = written(reached.unionByName(ahead).groupBy(store, "url").agg(F.min("_at").alias("_at")), "trail")
        if (now := reached.count()) == known:
            return reached.select(store, "url", F.row_number().over(Window.partitionBy(store).orderBy("_at")).cast("long").alias("place"))
        known, step = now, 2 * step
        then = jumps.select(store, F.col("url").alias("to"), F.col("to").alias("_to"))
        jumps = written(jumps.join(then, [store, "to"]).select(store, "url", F.col("_to").alias("to")), "jumps")


def linked_products(starts: DataFrame, pages: DataFrame, products: str, base: str = "base", store: str = "store_id", url: str = "url", html: str = "html") -> DataFrame:
    """(store, url, page, position): product links (a selector) of the list pages a crawl gets to by any pager link
    from its start pages, ``MAX_PAGES`` at most; each absolute URL once, where it is met first."""
    read = markup.read(F.col(html), {"products": (products, {"link": ("", "href")}), "pager": (PAGE_LINKS, {"link": ("", "href")})})
    parsed = pages.select(store, F.col(url).alias("url"), base, read.alias("_p")).groupBy(store, "url").agg(F.max(F.struct("_p", base)).alias("_s"))
    full = lambda c: F.transform(F.filter(c, lambda x: F.coalesce(~x["link"].isin("", "#"), F.lit(False))), lambda x: absolute(x["link"], F.col(f"_s.{base}")))
    hrefs = F.transform(F.filter("_s._p.products", lambda x: F.coalesce(x["link"] != "", F.lit(False))), lambda x: absolute(x["link"], F.col(f"_s.{base}")))
    parsed = written(parsed.select(store, "url", full("_s._p.pager").alias("links"), hrefs.alias("products")), "links")
    visited = frontier(starts, parsed, store)
    found = visited.join(parsed, [store, "url"]).select(store, "place", F.posexplode("products").alias("position", "url"))
    return found.groupBy(store, "url").agg(F.min(F.struct(F.col("place").alias("page"), "position")).alias("_f")).select(store, "url", "_f.*")


def followed_products(starts: DataFrame, pages: DataFrame, words: tuple[str, ...] = (), base: str = "base", store: str = "store_id", url: str = "url", html: str = "html") -> DataFrame:
    """The cards of woocommerce list pages, from each start page on by the page's own link to the next.

    It stops at a page without cards, one that did not land, or one it has seen.  Only names with all ``words`` are taken, whatever
    their case."""
    read = pages.select(store, F.col(url).alias("url"), base, payloads.list_page(F.col(html), "woocommerce").alias("_p"))
    parsed = read.groupBy(store, "url").agg(F.max(F.struct("_p", base)).alias("_s")).select(store, F.col("url").alias("page_url"), F.col(f"_s.{base}").alias(base), "_s._p.cards", "_s._p.pager")
    parsed = written(parsed, "pages")
    following = F.get("pager", 0)["link"]
    named = F.exists("cards", lambda c: F.coalesce(payloads.clean_markup(c["title"]) != "", F.lit(False)))
    visited = trail(starts, parsed.select(store, F.col("page_url").alias("url"), F.when(named, absolute(following, F.col(base))).alias("to")), store)
    read = parsed.join(visited.select(store, F.col("url").alias("page_url"), F.col("place").alias("page")), [store, "page_url"])
    rows = payloads.card_rows(read.select(store, "page", "cards"), "woocommerce")
    for w in words:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(w.lower())))
    return rows


def with_details(urls: DataFrame, details: DataFrame, strict: bool = False, store: str = "store_id", url: str = "url", html: str = "html") -> DataFrame:
    """``urls`` with the JSON-LD product of each one's own landed page; URLs whose page did not land or has no product are left
    out.  Of a page that landed several times the greatest text counts."""
    landed = details.join(urls.select(store, F.col("url").alias(url)), [store, url], "left_semi").groupBy(store, F.col(url).alias("url")).agg(F.max(html).alias("_html"))
    return payloads.json_ld(urls.join(landed, [store, "url"]), "_html", strict)
