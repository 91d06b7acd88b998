"""Query on embeddings: nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import vp_search


def op7_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vp_search.nearest(embeddings, lambda i: i % 50 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), n as (select vec_id, e, list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x) as sq from v),
p as (
  select q.vec_id as query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda s, x: s + x) / (sqrt(q.sq) * sqrt(c.sq)) as score
  from n q join n c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

QUERIES = {"op7_vp_search": op7_vp_search}
ORACLE_SQL = {"op7_vp_search": ORACLE}
