"""Change sets: manual reviews, subscriptions, catalog edits; and run reports.

A change set is a DataFrame; the result tells what became of each change and the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.stock import fan_out

REVIEWED_DAYS = 14
#: Columns of the review report (fixed values, in order).
REPORT_FIELDS = ["store_product_id", "tienda", "raw_name", "raw_variant", "raw_tags", "precio", "match_status", "product_type", "set_code", "language", "packaging", "category_slug", "candidato_id", "candidato_nombre", "candidato_set_code", "candidato_language", "candidato_packaging", "similarity_score", "es_fallback", "motivo"]


def apply_reviews(listings: DataFrame, changes: DataFrame, pairs: DataFrame, products: DataFrame, key: list[str], now=None) -> DataFrame:
    """Outcome of confirm, reject and reopen requests, with the listing's new status, product and score.

    confirm needs a known product (else 422) and keeps the score only if the product is among the
    candidates; reject drops the product but not the score; reopen needs a confirmed listing (else
    409) and clears all.  Unknown listings are 404.  Every change is judged on the state before the
    batch, so give one change of a listing at a time (``latest_changes``).  With ``now`` there are also
    ``new_reviewed_at`` and ``new_reason``, which reject sets and nothing clears."""
    c, li = changes.alias("c"), listings.alias("l")
    joined = c.join(li, [F.col(f"c.{k}") == F.col(f"l.{k}") for k in key], "left")
    p = products.select(F.col("product_id").alias("_known")).distinct()
    joined = joined.join(p, F.col("c.chosen_id") == F.col("_known"), "left")
    s = pairs.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("product_id").alias("_pid"), F.col("score").alias("_score"))
    joined = joined.join(s, [*(F.col(f"c.{k}") == F.col(f"_{k}") for k in key), F.col("c.chosen_id") == F.col("_pid")], "left")
    action, missing = F.col("c.action"), F.col(f"l.{key[0]}").isNull()
    code = F.when(missing, 404).when((action == "confirm") & F.col("_known").isNull(), 422).when((action == "reopen") & (F.col("l.match_status") != "confirmed"), 409).otherwise(200)
    done = code == 200
    status = F.when(done & (action == "confirm"), "confirmed").when(done & (action == "reject"), "not_applicable").when(done, "needs_review").otherwise(F.col("l.match_status"))
    product = F.when(done & (action == "confirm"), F.col("c.chosen_id")).when(~done, F.col("l.product_id"))
    score = F.when(done & (action == "confirm"), F.col("_score")).when(done & (action == "reopen"), F.lit(None)).otherwise(F.col("l.match_confidence"))
    return joined.select(*(F.col(f"c.{k}").alias(k) for k in key), action.alias("action"), code.alias("code"), status.alias("new_status"), product.alias("new_product_id"), score.alias("new_confidence"), *([] if now is None else _reviewed(done & (action == "reject"), now)))


def _reviewed(rejected: Column, now) -> list[Column]:
    return [F.when(rejected, F.lit(now)).otherwise(F.col("l.reviewed_at")).alias("new_reviewed_at"), F.when(rejected, F.col("c.reason")).otherwise(F.col("l.reviewed_reason")).alias("new_reason")]


def latest_changes(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last change of each listing in a batch."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def not_hidden(listings: DataFrame, now, days: int = REVIEWED_DAYS) -> DataFrame:
    """Listings that were never reviewed, or longer than ``days`` ago."""
    return listings.filter(F.col("reviewed_at").isNull() | (F.col("reviewed_at") < F.lit(now) - F.make_dt_interval(F.lit(days))))


def add_subscriptions(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """409 for subscriptions that exist (nulls equal each other), 201 for the others."""
    e, w = existing.select(*key).distinct().withColumn("_has", F.lit(True)).alias("e"), wanted.alias("w")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    return w.join(e, same, "left").select("w.*", F.when(F.col("_has"), 409).otherwise(201).alias("code"))


def drop_subscriptions(existing: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    return existing.join(dead.select(key).distinct(), key, "left_anti")


def name_collisions(products: DataFrame, changes: DataFrame, scope: str = "game_slug", name: str = "name_canonical", own: str = "product_id") -> DataFrame:
    """409 for new names that another product of the game has, 200 else; a product never collides with itself."""
    c, p = changes.alias("c"), products.alias("p")
    hit = c.join(p, (F.col(f"c.{scope}") == F.col(f"p.{scope}")) & (F.col("c.new_name") == F.col(f"p.{name}")) & (F.col(f"c.{own}") != F.col(f"p.{own}")), "left_semi")
    flagged = hit.select(F.col(own).alias("_own")).distinct().withColumn("_hit", F.lit(True))
    return changes.join(flagged, F.col(own) == F.col("_own"), "left").withColumn("code", F.when(F.col("_hit"), 409).otherwise(200)).drop("_own", "_hit")


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column comes: (column, value, n), from one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def cheapest_per_set(listings: DataFrame, set_col: str, store_col: str, price_col: str) -> DataFrame:
    return listings.filter(F.col(set_col).isNotNull()).groupBy(set_col, store_col).agg(F.min(price_col).alias("min_price"))


def latest_runs(runs: DataFrame, label: str, time: str, keep: int = 20) -> DataFrame:
    """The newest runs of each kind."""
    order = Window.partitionBy(label).orderBy(F.desc(time), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def review_queue(pairs: DataFrame, listings: DataFrame, key: list[str], status: str | None = "needs_review", low: float | None = None, high: float | None = None) -> DataFrame:
    """Listings of a status (none given: all but not applicable) with their candidates; with a bound
    on the best score, listings without one are left out."""
    rows = listings.filter(F.col("match_status") == status) if status else listings.filter("match_status <> 'not_applicable'")
    c = F.struct("rank", "product_id", "score", "is_fallback")
    best = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(c)).alias("candidates"))  # at most k each
    rows = rows.join(best, key, "left")
    top = F.get("candidates", 0)["score"]
    if low is not None:
        rows = rows.filter(F.coalesce(top >= low, F.lit(False)))
    if high is not None:
        rows = rows.filter(F.coalesce(top <= high, F.lit(False)))
    return rows


def review_report(listings: DataFrame, best: DataFrame, stores: DataFrame, key: list[str], motive: Column) -> DataFrame:
    """The review queue with each listing's best candidate and why it waits, for ``sinks.write_csv``.

    ``listings``: key, listing_id, raw_name, raw_variant, raw_tags, price, match_status, product_type,
    cls_set_code, cls_language, cls_packaging, category_slug; ``best``: the first candidate with its
    evidence.  Missing values are empty texts, but for the price and the candidate's id."""
    waiting = listings.filter(F.col("match_status").isin("needs_review", "unmatched"))
    b = best.select(*key, "product_id", "name_canonical", "p_set_code", "p_language", "p_packaging", "score", "is_fallback", motive.alias("_motive"))
    d = waiting.join(b, key, "left").join(stores.select("store_id", "store_name"), "store_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = {"store_product_id": F.col("listing_id"), "tienda": F.col("store_name"), "precio": F.col("price"), "candidato_id": F.col("product_id"), "candidato_nombre": text("name_canonical"), "similarity_score": F.coalesce(F.format_string("%.4f", "score"), F.lit("")), "es_fallback": F.coalesce("is_fallback", F.lit(False)), "motivo": F.coalesce("_motive", F.lit("sin_candidato_en_la_categoria"))}
    source |= {f: text(f"cls_{f}") for f in ("set_code", "language", "packaging")} | {f"candidato_{f}": text(f"p_{f}") for f in ("set_code", "language", "packaging")}
    return d.select(*(source.get(f, text(f)).alias(f) for f in REPORT_FIELDS))


def create_products(products: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``wanted`` with 409 where the catalog has the key already, or an earlier row of the batch (by
    ``request``) does; 201 for the others, which are to be appended."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy("request"))
    has = products.select(*key).distinct().withColumn("_has", F.lit(True))
    d = wanted.withColumn("_n", first).join(has, key, "left")
    return d.withColumn("code", F.when(F.col("_has") | (F.col("_n") > 1), 409).otherwise(201)).drop("_n", "_has")


def patch_rows(old: DataFrame, patches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new state, codes): every patch (at most one a key) sets the columns named in its array ``fields``,
    to null too; unknown keys are 404, the others 200."""
    o, p = old.alias("o"), patches.alias("p")
    joined = o.join(p, F.col(f"o.{key}") == F.col(f"p.{key}"), "left")
    value = lambda c: F.when(F.array_contains("p.fields", c), F.col(f"p.{c}")).otherwise(F.col(f"o.{c}")) if c != key and c in patches.columns else F.col(f"o.{c}")
    known = old.select(key).distinct().withColumn("_known", F.lit(True))
    codes = patches.select(key).join(known, key, "left").select(key, F.when(F.col("_known"), 200).otherwise(404).alias("code"))
    return joined.select(*(value(c).alias(c) for c in old.columns)), codes


def notifications(events: DataFrame, listings: DataFrame, products: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, subscriber_id, name_canonical): whom to tell of each event (event_id, listing_id,
    product_id); ``listings`` (listing_id, store_id) give its store."""
    placed = events.join(listings.select("listing_id", "store_id"), "listing_id").join(products.select("product_id", "name_canonical"), "product_id")
    return fan_out(placed, subscriptions).select("event_id", "subscriber_id", "name_canonical")


def notification_counts(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Per event how many were told and how many subscriptions proved dead (``outcome``: sent, dead, failed)."""
    n = deliveries.groupBy("event_id").agg(F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "dead").alias("dead"))
    return events.select("event_id").join(n, "event_id", "left").select("event_id", F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("dead", F.lit(0)).alias("dead"))


def locate_stores(rows: DataFrame, labels: DataFrame, stores: DataFrame) -> DataFrame:
    """``rows`` (with ``label``) with the ``store_id`` of their label's address; null where it is unknown."""
    known = labels.select("label", "website_url").join(stores.select("store_id", "website_url"), "website_url").groupBy("label").agg(F.min("store_id").alias("store_id"))
    return rows.join(known, "label", "left")


def progress(message: Column) -> Column:
    """(page, total) that a log line reports; null without one, total null if it states none."""
    word = r"(?:página|producto)\s+(\d+)(?:/(\d+))?"
    number = lambda k: F.nullif(F.regexp_extract(message, word, k), F.lit("")).try_cast("int")
    return F.when(message.rlike(word), F.struct(number(1).alias("page"), number(2).alias("total")))


def log_tail(lines: DataFrame, run: str, number: str, keep: int = 200) -> DataFrame:
    """The last lines of each run's log."""
    last = Window.partitionBy(run).orderBy(F.desc(number))
    return lines.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= keep).drop("_n")
