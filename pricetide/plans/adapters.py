"""Domain tables as views over the given tables.

``lineitem`` plays the price observations (supplier = store, part = product), ``part`` the catalog,
``supplier`` the stores, ``customer`` the subscribers and ``events`` the stock signals of a listing.
``SQL`` states the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Domain:
    """The domain tables of one folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table of few bytes with much work per row: its rows dealt evenly, however few splits its file has."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 3 * self.spark.sparkContext.defaultParallelism)
        return self.raw(name).repartition(parts)

    @property
    def store(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), F.concat(F.lit("https://shop"), F.col("s_suppkey"), F.lit(".example")).alias("website_url"), (F.col("s_acctbal") >= 0).alias("active"), F.col("s_nationkey").alias("nation_id"))

    @property
    def product(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name_canonical"),
            F.col("p_type").alias("game_slug"),
            F.concat_ws("/", "p_type", "p_brand").alias("category_slug"),
            F.format_string("OP%02d", F.col("p_size") % 17 + 1).alias("set_code"),
            F.when(F.col("p_partkey") % 3 == 0, "JP").otherwise("EN").alias("language"),
            F.when(F.col("p_partkey") % 4 == 0, "display").otherwise("sobre").alias("packaging"),
            (F.col("p_size") > 45).alias("is_hot"),
        )

    @property
    def observation(self) -> DataFrame:
        x = self.raw("lineitem")
        return x.select(
            F.col("l_suppkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_shipdate").cast("date").alias("scraped_date"),
            (F.round(F.col("l_extendedprice") * 100) / F.round("l_quantity")).cast("long").cast("decimal(12,0)").alias("cents"),
            F.when(F.col("l_linestatus") == "O", "disponible").otherwise("agotado").alias("stock_status"),
            F.when(F.col("l_returnflag") == "R", "needs_review").otherwise("confirmed").alias("match_status"),
            F.struct("l_orderkey", "l_linenumber").alias("seq"),
        ).withColumn("price", (F.col("cents") / 100).cast("decimal(12,2)")).drop("cents")

    @property
    def price_history(self) -> DataFrame:
        last = Window.partitionBy("store_id", "product_id", "scraped_date").orderBy(F.desc("seq"))
        return self.observation.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    @property
    def store_product(self) -> DataFrame:
        last = Window.partitionBy("store_id", "product_id").orderBy(F.desc("scraped_date"), F.desc("seq"))
        return self.observation.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    @property
    def signal(self) -> DataFrame:
        """Stock signals: a listing's key, its time and what was seen."""
        e = self.raw("events")
        status = F.when(F.col("event_type") == "error", "agotado").when(F.col("event_type") == "purchase", "disponible").otherwise("desconocido")
        return e.select(F.col("user_id").alias("listing_id"), "ts", "event_id", status.alias("stock_status"))

    @property
    def subscription(self) -> DataFrame:
        """Every customer follows one product, in any store or in one."""
        c = self.raw("customer")
        n = self.raw("part").count()
        return c.select(F.col("c_custkey").alias("subscriber_id"), (F.col("c_custkey") * 7 % n + 1).alias("product_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") + 1).cast("long").alias("store_id"))

    @property
    def listing(self) -> DataFrame:
        """What a store calls a product, with attributes that do not always agree with the catalog's."""
        sp = self.store_product.join(self.product.select("product_id", "name_canonical", "category_slug", "set_code", "language", "packaging"), "product_id")
        n = F.col("store_id") + F.col("product_id")
        return sp.select(
            "store_id",
            F.col("product_id").alias("listed_id"),
            F.when(n % 5 == 0, F.concat(F.lit("Oferta "), F.col("name_canonical"))).when(n % 5 == 1, F.upper("name_canonical")).when(n % 5 == 2, F.expr("substring(name_canonical, 1, length(name_canonical) div 2)")).otherwise(F.concat(F.col("name_canonical"), F.lit(" x12"))).alias("raw_name"),
            "category_slug",
            F.when(n % 7 < 3, F.col("set_code")).when(n % 7 == 3, "OP99").alias("cls_set_code"),
            F.when(n % 11 == 0, "KR").when(n % 11 == 1, F.lit(None)).otherwise(F.col("language")).alias("cls_language"),
            F.when(n % 13 > 2, F.col("packaging")).alias("cls_packaging"),
            "match_status",
        )


SQL = """
store as (select s_suppkey as store_id, s_name as store_name, 'https://shop' || s_suppkey || '.example' as website_url, s_acctbal >= 0 as active, s_nationkey as nation_id from supplier),
product as (
  select p_partkey as product_id, p_name || ' ' || p_brand || ' ' || p_type as name_canonical, p_type as game_slug, p_type || '/' || p_brand as category_slug,
    printf('OP%02d', p_size % 17 + 1) as set_code, case when p_partkey % 3 = 0 then 'JP' else 'EN' end as language,
    case when p_partkey % 4 = 0 then 'display' else 'sobre' end as packaging, p_size > 45 as is_hot from part),
observation as (
  select l_suppkey as store_id, l_partkey as product_id, cast(l_shipdate as date) as scraped_date,
    cast(cast(trunc(round(l_extendedprice * 100) / round(l_quantity)) as bigint) as decimal(12,0)) / 100 as price_raw,
    case when l_linestatus = 'O' then 'disponible' else 'agotado' end as stock_status,
    case when l_returnflag = 'R' then 'needs_review' else 'confirmed' end as match_status, l_orderkey, l_linenumber from lineitem),
obs as (select * exclude (price_raw), cast(price_raw as decimal(12,2)) as price from observation),
price_history as (select * from obs qualify row_number() over (partition by store_id, product_id, scraped_date order by l_orderkey desc, l_linenumber desc) = 1),
store_product as (select * from obs qualify row_number() over (partition by store_id, product_id order by scraped_date desc, l_orderkey desc, l_linenumber desc) = 1),
signal as (
  select user_id as listing_id, ts, event_id, case event_type when 'error' then 'agotado' when 'purchase' then 'disponible' else 'desconocido' end as stock_status from events),
subscription as (
  select c_custkey as subscriber_id, c_custkey * 7 % (select count(*) from part) + 1 as product_id, case when c_custkey % 3 <> 0 then cast(c_nationkey + 1 as bigint) end as store_id from customer),
listing as (
  select store_id, product_id as listed_id,
    case (store_id + product_id) % 5 when 0 then 'Oferta ' || name_canonical when 1 then upper(name_canonical) when 2 then substring(name_canonical, 1, cast(length(name_canonical) // 2 as bigint)) else name_canonical || ' x12' end as raw_name,
    category_slug, case when (store_id + product_id) % 7 < 3 then set_code when (store_id + product_id) % 7 = 3 then 'OP99' end as cls_set_code,
    case (store_id + product_id) % 11 when 0 then 'KR' when 1 then null else language end as cls_language,
    case when (store_id + product_id) % 13 > 2 then packaging end as cls_packaging, match_status
  from store_product join product using (product_id))
"""
