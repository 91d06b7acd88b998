"""Query on media columns: texts as motion-JPEG frames in AVI files, read back and cut into shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import media


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = media.load(media.store(documents))
    clip = lambda c: F.concat_ws(":", c["first_frame"].cast("string"), c["n_frames"].cast("string"), F.format_string("%.3f", c["mean_level"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", clip), ";").alias("feature"),
    )


QUERIES = {"op8_media": op8_media}
ORACLE_SQL: dict[str, str] = {}
