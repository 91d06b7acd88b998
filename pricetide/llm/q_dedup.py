"""Queries on repeated text: substrings and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import minhash, substring_dedup


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = substring_dedup.remove_repeats(documents)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
least as (select h, min(doc_id) as lead from win group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from win join least using (h) where lead < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
kept as (
  select doc_id, count(gone.pos) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where gone.pos is null), '') as text
  from words left join gone using (doc_id, pos) group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
ends as (select a as u, b as v from links union all select b, a from links),
reach as (select distinct u, u as r from ends union select e.v, reach.r from reach join ends e on e.u = reach.u),
comp as (select u as doc_id, min(r) as c from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c, w.doc_id) as component_id, coalesce(c, w.doc_id) = w.doc_id as kept from w left join n using (doc_id) left join comp using (doc_id)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup, "op6_minhash": op6_minhash}
ORACLE_SQL = {"op4_substring_dedup": OP4_SQL, "op6_minhash": OP6_SQL}
