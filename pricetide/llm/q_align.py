"""Query on the alignment of two tokenizers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import align

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), BYTES, PIECES)


#: Tokenizers are beyond SQL: tests compare with both libraries on whole texts.
QUERIES = {"op13_align": op13_align}
ORACLE_SQL: dict[str, str] = {}
