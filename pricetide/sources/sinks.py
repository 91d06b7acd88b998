"""Writers: CSV reports, snapshots, daily partitions, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PRODUCT_FIELDS = ["store", "platform", "id_product", "name", "variant", "product_type", "main_set", "set_code", "language", "price", "stock_status", "url", "sku", "image_url"]

FAILED_STORE_FIELDS = ["store", "platform", "reason"]


def camel(df: DataFrame) -> DataFrame:
    """Columns named as interfaces outside want them: camelCase."""
    name = lambda c: c.split("_")[0] + "".join(x.capitalize() for x in c.split("_")[1:])
    return df.toDF(*map(name, df.columns))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    (df.select(*fields) if fields else df).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, folder: str) -> str:
    """A new snapshot beside the older ones, which readers of the old one keep; returns its path."""
    path = f"{folder}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def write_days(df: DataFrame, path: str, day: str = "scraped_date") -> None:
    """Replace just the days that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table, for those who still have one."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
