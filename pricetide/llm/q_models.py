"""Queries on models of text: toxicity and language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import lm, toxicity


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(documents, model).select("doc_id", "severity", "grade", "toxic")


QUERIES = {"op9_lm": op9_lm, "op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
