"""Queries that audit a corpus: filters and their order, benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import decontaminate, filter_audit


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    failures = filter_audit.text_failures(documents.select("doc_id", "text", "source"))
    rows = filter_audit.steps(filter_audit.edges(filter_audit.with_marks(failures, labels)))
    lost = [F.col("removed_good").alias("good_lost"), F.col("removed_toxic").alias("toxic_lost")]
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.find(documents.select("doc_id", "text"), benchmark)
    n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP11_SQL = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(min(doc_id) over (partition by text) < doc_id, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by 1, 2),
v as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o as (select [a.c, b.c, c.c, d.c, e.c] as cs, [a.b, b.b, c.b, d.b, e.b] as bs from v a, v b, v c, v d, v e where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31),
s as (select array_to_string(cs, '') as filter_order, unnest(range(1, 6)) as step, cs, bs from o),
t as (select filter_order, step, cs[step] as c, bs[step] as b, coalesce(list_sum(bs[1:step - 1]), 0)::int as before from s),
r as (select part, filter_order, step, c,
    sum(case when mask & (before | b) = 0 then n else 0 end) as kept, sum(case when mask & b <> 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & b <> 0 and mask & before <> 0 then n else 0 end) as redundant, sum(case when mask = b then n else 0 end) as unique_fails,
    sum(case when mask & b <> 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & b <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
  from t, m group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, c) as shapley from r
"""

OP12_SQL = r"""
with t as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
b as (select distinct id as item_id, width, array_to_string(w[i:i + width - 1], ' ') as g
  from (select id, w, least(len(w), 10) as width, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from w where kind = 'b' and len(w) > 0)),
d as (select id as doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') as g
  from (select id, w, width, unnest(range(1, len(w) - width + 2)) as i from w, (select distinct width from b) where kind = 'd' and len(w) >= width)),
hit as (select distinct doc_id, i, width, item_id from d join b using (width, g)),
p as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + width)) as pos from hit) group by 1),
x as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by 1)
select w.id as doc_id, len(w.w) as n_words, coalesce(p.n, 0) as n_hit, coalesce(x.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, p.n is not null as contaminated
from w left join p on p.doc_id = w.id left join x on x.doc_id = w.id where kind = 'd'
"""

QUERIES = {"op11_filter_audit": op11_filter_audit, "op12_decontaminate": op12_decontaminate}
ORACLE_SQL = {"op11_filter_audit": OP11_SQL, "op12_decontaminate": OP12_SQL}
