"""The corpus pipeline: stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet to shared storage and reads them back as the next one's input, so a lost executor costs
the running stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import minhash, packing, substring_dedup, toxicity
from pricetide.llm.common import materialize
from pricetide.llm.q_tokens import TOKENIZER

#: Similarity in percent from which documents count as copies.
NEAR = 80


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but id and text under a name that no operator adds, and the names by those."""
    names = {f"_own{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic.

    Texts without words (null, empty, blank) stay; rows are judged one by one, also with equal or null ids."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = _apart(docs)
    return toxicity.score(rows, model).filter("not toxic").drop("severity", "grade", "toxic").withColumnsRenamed(names).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group.

    Texts without words are in no group, and neither are rows without an id; all rows of an id go or stay together."""
    groups = minhash.near_duplicates(docs, percent=NEAR)
    losers = groups.filter("not kept").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold, ``n_chars`` (if there is such a column) brought up to
    date; documents that lose every word go.

    Null texts and texts without words stay as they are; rows of one id never count against each other, and
    rows without an id lose nothing."""
    rows, names = _apart(docs)
    cleaned = substring_dedup.remove_repeats(rows, collapse=False).filter("n_removed = 0 or n_removed < n_words")
    for own, name in names.items():
        if name == "n_chars":
            shorter = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(own))
            cleaned = cleaned.withColumn(own, shorter.cast(docs.schema[name].dataType))
    return cleaned.drop("n_words", "n_removed", "removed").withColumnsRenamed(names).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is an empty one, which is its end token alone.  Other columns are not
    read."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", reject_toxic), ("near-duplicates", drop_near_copies), ("repeats", drop_repeats), ("packing", pack)]

#: Trained models and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; an empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
