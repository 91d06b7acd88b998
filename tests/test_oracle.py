"""Every registered query beside its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from pricetide import page_queries, report_queries, review_queries, shop_queries, table_queries  # noqa: F401 (each adds its queries)

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6)
    return v if isinstance(v, datetime.date) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(review_queries.QUERIES))
def test_against_sql(spark, con, name):
    df = review_queries.QUERIES[name](spark, FOLDER)
    got, want = df.collect(), con.sql(review_queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(got, df.columns) == table(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
