"""Titles in texts: of very many titles the first in a table's order that a text holds.

Tables are DataFrames (table, place, title, code).  Up to ``MOST`` titles go to the tasks as one automaton (Aho and
Corasick's), which reads each text once whatever the number of titles.  Beyond that texts and titles
meet on each title's rarest trigram, and only those that meet are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Titles, of this many characters in all, that are sent to tasks: some 100 MB as an automaton.
MOST, MOST_CHARACTERS = 100_000, 4_000_000


@lru_cache(maxsize=4)
def _automaton(rows: tuple[tuple[str, str, str | None], ...]) -> tuple[ahocorasick.Automaton, dict[str, str | None]]:
    """Titles to their lines' numbers (by table the first of each), and the codes of empty titles, which every text holds."""
    machine, lines, always = ahocorasick.Automaton(), {}, {}
    for k, (table, title, code) in enumerate(rows):
        if title:
            lines.setdefault(title, {}).setdefault(table, (k, code))
        else:
            always.setdefault(table, (k, code))
    for title, own in lines.items():
        machine.add_word(title, tuple((table, *hit) for table, hit in own.items()))
    machine.make_automaton()
    return machine, always


def _by_automaton(df: DataFrame, text: str, rows: list[tuple[str, str, str | None]], out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tuple(rows))

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, always = _automaton(shared.value)
        for texts in batches:
            found = []
            for t in texts:
                best = dict(always) if t is not None else {}
                for _, hits in machine.iter(t) if t and len(machine) else ():
                    for table, k, code in hits:
                        if table not in best or k < best[table][0]:
                            best[table] = (k, code)
                found.append({table: code for table, (_, code) in best.items()})
            yield pd.Series(found, dtype=object)

    return df.withColumn(out, codes(F.col(text)))


def _by_join(df: DataFrame, text: str, titles: DataFrame, out: str) -> DataFrame:
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    sized = lambda n: F.when(F.length("_t") >= n, grams(F.col("_t"), n)).otherwise(F.array().cast("array<string>"))
    lines = titles.select("table", "place", F.col("title").alias("_t"), "code")
    own = F.when(F.length("_t") >= 3, F.array_distinct(grams(F.col("_t"), 3))).otherwise(F.array("_t"))
    exploded = lines.withColumn("_g", F.explode(own))
    often = exploded.groupBy("_g").agg(F.count("*").alias("_n"))
    keyed = exploded.join(often, "_g").groupBy("table", "place", "_t", "code").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g")).withColumnRenamed("_t", "_title")
    texts = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    met = texts.withColumn("_g", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), sized(1), sized(2), sized(3))))).join(keyed, "_g").filter(F.contains("_t", F.col("_title")))
    first = met.groupBy("_t", "table").agg(F.min_by("code", "place").alias("code"))
    maps = first.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("table", "code"))).alias(out))  # one entry a table
    nothing = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    return df.join(maps, F.col(text) == F.col("_t"), "left").select(*df.columns, F.coalesce(out, nothing).alias(out))


def with_titles(df: DataFrame, text: str, titles: DataFrame, out: str = "titles") -> DataFrame:
    """``df`` with a map from each table to the code of the first of its lines (smallest ``place``) whose title is in the text.

    Tables without such a line are not in the map; a null text holds nothing; lines without a title are left out, an
    empty title is in every text.  A table's places are distinct."""
    titles = titles.select("table", "place", "title", "code").filter("title is not null")
    size = titles.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("title")), F.lit(0)).alias("m")).first()
    if size.n > MOST or size.m > MOST_CHARACTERS:
        return _by_join(df, text, titles, out)
    return _by_automaton(df, text, [(r.table, r.title, r.code) for r in titles.orderBy("place").collect()], out)
