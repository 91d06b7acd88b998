"""What a chain of filters removes, for every order in which the filters may be applied.

A document's failures are a set of filters; of the sets only their counts matter.  The states of the
subset lattice are the sets of filters applied so far, and an edge adds one filter.  Counting paths
forward from the empty set gives the number of orders that reach a state, counting backward from
the full set the number that leave it; both together say how many orders take an edge.  What an edge
removes, weighted by these, sums to the filter's Shapley value over all orders, and the steps of each
single order are read from the same edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import free_names, materialize, slices, tidy

#: The five text filters, by letter.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: More filters than this have too many orders to list (7! * 7 rows for each part).
MOST_FILTERS = 7


@dataclass(frozen=True)
class Lattice:
    """Edges of the subset lattice of ``n`` filters: ``state[e]`` gets filter ``added[e]``;
    ``arriving`` orders reach the state and ``leaving`` go on from the next one."""

    n: int
    state: np.ndarray
    added: np.ndarray
    arriving: np.ndarray
    leaving: np.ndarray


def lattice(n: int) -> Lattice:
    pairs = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    forward, backward = [1] + [0] * ((1 << n) - 1), [0] * ((1 << n) - 1) + [1]
    for s, f in pairs:  # a state's predecessors are smaller numbers
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(pairs):
        backward[s] += backward[s | 1 << f]
    state, added = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return Lattice(n, state, added, np.array(forward)[state], np.array(backward)[state | 1 << added])


def orders(edges: Lattice, names: Sequence[str]) -> list[tuple[str, int, int, str]]:
    """(order, step, state, filter) of every path through the lattice."""
    out = []

    def walk(state: int, path: list[tuple[int, int]]) -> None:
        if len(path) == edges.n:
            label = "".join(names[f] for _, f in path)
            out.extend((label, k + 1, s, names[f]) for k, (s, f) in enumerate(path))
        for f in edges.added[edges.state == state].tolist():
            walk(state | 1 << f, [*path, (state, f)])

    walk(0, [])
    return out


def text_failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A .. E) for every row of ``df``; true where the text fails.

    A: fewer than 50 words.  B: less than 65 percent of the words distinct.  C: more than 5 percent of the
    characters are A-Z.  D: holds one of ``#$%&*|``.  E: equal to the text of a smaller id.  A null
    text is the empty one, a null part the empty string.  Rows of the same id are no copies of each other; a row
    without id is no copy and makes none.  Other columns are not read; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType().add("id", kind).add("part", T.StringType()).add("digest", T.BinaryType()).add("mask", T.IntegerType())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            column = part.column("text")
            points = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            digests, masks = [], []
            for raw, length in zip(column.cast(pa.binary()).to_pylist(), points, strict=True):
                raw = raw or b""
                words = raw.split()
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                few, dull = len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
                loud, signs = 100 * capitals > CAPITAL_PERCENT * length, len(raw.translate(None, _SIGNS)) < len(raw)
                digests.append(hashlib.sha256(raw).digest())
                masks.append(few | dull << 1 | loud << 2 | signs << 3)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])

    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(run, out), "failures")
    known = rows.filter("id is not null")
    # the key of the join holds the id, so that a text that very many rows share is no hot key
    leads = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("leads", F.lit(True))
    marked = known.join(leads, ["digest", "id"], "left").unionByName(rows.filter("id is null").withColumn("leads", F.lit(True)))
    own = [F.col("mask").bitwiseAND(1 << k).cast("boolean").alias(c) for k, c in enumerate(FILTERS[:4])]
    return marked.select("id", "part", *own, F.col("leads").isNull().alias("E"))


def with_marks(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``failures`` with ``good`` (a label of quality 1) and ``toxic`` (a label of toxic 1) by id.  Several labels
    of one id count together; rows without id or label have neither."""
    good, toxic = (F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic")))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(good, toxic)
    none = [F.lit(False).alias("good"), F.lit(False).alias("toxic")]
    known = failures.filter("id is not null").join(marks, "id", "left").fillna(False, ["good", "toxic"])
    return known.unionByName(failures.filter("id is null").select("*", *none))


def edges(failures: DataFrame, filters: Sequence[str] = FILTERS, part_col: str = "part", marks: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """A row for each part and edge of the lattice of ``filters`` (boolean columns; null: passes).

    state: bits of the filters applied before; filter; arriving, leaving: orders that reach the state
    and go on behind the edge; removed: fail this filter and none before; kept: fail none up to this one;
    redundant: fail it, but one before as well; unique_fails: fail it alone; removed_<mark>: removed and
    marked; shapley: what the filter removes, summed over all orders.  Only counts of failure sets are
    brought together, 2^n at most for each part.  An empty table has no parts.
    """
    n, names = len(filters), list(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters, not {n}")
    graph = lattice(n)
    own_mask, own_rows = free_names(failures, "_mask", "_rows")
    mask = sum((F.when(F.col(c), 1 << k).otherwise(0) for k, c in enumerate(names)), F.lit(0))
    sums = [F.count("*").alias("n"), *(F.count_if(F.col(m)).alias(f"n_{m}") for m in marks)]
    counted = failures.groupBy(F.col(part_col).alias("part"), mask.alias(own_mask)).agg(*sums)
    sets = counted.groupBy("part").agg(F.collect_list(F.struct(own_mask, "n", *(f"n_{m}" for m in marks))).alias(own_rows))
    out = T.StructType().add("part", failures.schema[part_col].dataType).add("state", T.IntegerType()).add("filter", T.StringType())
    for c in ("arriving", "leaving", "kept", "removed", "redundant", "unique_fails", *(f"removed_{m}" for m in marks), "shapley"):
        out = out.add(c, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.arange(1 << n)
        bit = 1 << graph.added
        taken = ((masks & graph.state[:, None]) == 0) & ((masks & bit[:, None]) != 0)
        stays = (masks & (graph.state | bit)[:, None]) == 0
        fails = (masks & bit[:, None]) != 0
        for batch in batches:
            parts = batch.num_rows
            rows = batch.column(own_rows)
            at = np.repeat(np.arange(parts), rows.value_lengths().to_numpy(zero_copy_only=False))
            values = [rows.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2 + len(marks))]
            counts = np.zeros((1 + len(marks), parts, 1 << n), np.int64)
            for k, v in enumerate(values[1:]):
                counts[k, at, values[0]] = v
            removed = counts @ taken.T.astype(np.int64)
            weighted = removed[0] * (graph.arriving * graph.leaving)
            shapley = np.stack([weighted[:, graph.added == f].sum(axis=1) for f in range(n)], axis=1)
            wide = lambda x: np.broadcast_to(x, (parts, len(bit))).ravel()
            columns = [wide(graph.arriving), wide(graph.leaving), counts[0] @ stays.T, removed[0], counts[0] @ fails.T - removed[0], counts[0][:, bit], *removed[1:], shapley[:, graph.added]]
            labels = pa.array([names[f] for f in graph.added.tolist()] * parts)
            fixed = [batch.column("part").take(pa.array(np.repeat(np.arange(parts), len(bit)))), pa.array(wide(graph.state).astype(np.int32)), labels]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(np.ascontiguousarray(c).ravel()) for c in columns)], names=out.names)

    return sets.mapInArrow(run, out)


def steps(edge_rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """The edges in the sequence of every order: (part, filter_order, step) and the columns of ``edges``."""
    paths = edge_rows.sparkSession.createDataFrame(orders(lattice(len(filters)), list(filters)), "filter_order string, step int, state int, filter string")
    return edge_rows.join(F.broadcast(paths), ["state", "filter"])
