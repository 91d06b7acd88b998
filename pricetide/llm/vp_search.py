"""Nearest neighbours by vantage-point trees, one per shard.

Unit vectors at distance sqrt(2 - 2 cos) are a metric space, so the triangle inequality prunes
subtrees.  ``factor`` relaxes it: a subtree is left out once its lower bound times ``factor``
exceeds the k-th distance found; at one the search is exact, above one it is faster and may miss.

The search gives each query's k-th cosine; every point within rounding of it is then scored exactly, so
rounding in the tree changes nothing, however many points share a direction.  Rows are dealt over shards and queries over blocks, and each (shard, block) is one bounded group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import materialize

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 4096, 128
#: Queries whose points near the k-th place are in memory at once.
BAND_QUERIES = 256
#: Rounding of a cosine, with room to spare; distances near 0 go with its root.
_BAND = 1e-12


class VPTree:
    """Nodes in arrays.  A node's points are ``order[begin:end]``; an inner node keeps its vantage
    point and the range of distances of its near and far half."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        self._build(0, len(points), leaf)

    def _build(self, begin: int, end: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if end - begin <= leaf:
            self.nodes[me] = (begin, end)
            return me
        own = self.order[begin:end]
        # the vantage point: of the shard's points, the farthest from the first (ties to the earliest)
        far = int(np.argmax(distances(self.points[own], self.points[own[0]])))
        vantage = self.points[own[far]]
        d = distances(self.points[own], vantage)
        by = np.argsort(d, kind="stable")
        self.order[begin:end] = own[by]
        d, half = d[by], (end - begin) // 2
        near = self._build(begin, begin + half, leaf)
        rest = self._build(begin + half, end, leaf)
        self.nodes[me] = (vantage, near, d[0], d[half - 1], rest, d[half], d[-1])
        return me

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k nearest points, as distances and positions (-1: fewer); ``skip`` holds the
        id that a query may not find."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1)

        def visit(node: int, who: np.ndarray) -> None:
            parts = self.nodes[node]
            if len(parts) == 2:
                own = self.order[parts[0] : parts[1]]
                d = np.sqrt(np.maximum(0, 2 - 2 * queries[who] @ self.points[own].T))
                d[skip[who, None] == ids[None, own]] = np.inf
                both = np.concatenate((best[who], d), axis=1)
                where = np.concatenate((found[who], np.broadcast_to(own, d.shape)), axis=1)
                # ties at the k-th place go to the smaller id
                label = np.where(where >= 0, ids[where], np.iinfo(np.int64).max)
                pick = np.lexsort((label, np.round(both, 12)), axis=1)[:, :k]
                best[who] = np.take_along_axis(both, pick, axis=1)
                found[who] = np.where(np.isinf(best[who]), -1, np.take_along_axis(where, pick, axis=1))
                return
            vantage, near, a, b, rest, c, e = parts
            d = distances(queries[who], vantage)
            closer = d <= (b + c) / 2
            for child, low, high, first in ((near, a, b, closer), (rest, c, e, ~closer), (near, a, b, ~closer), (rest, c, e, closer)):
                bound = np.maximum(0, np.maximum(low - d, d - high))
                go = who[first & (bound * factor <= best[who, -1] + 1e-7)]
                if len(go):
                    visit(child, go)

        if len(self.points):
            visit(0, np.arange(len(queries)))
        return best, found


    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all pairs at most ``reach`` (one for each query) apart, or within rounding of it."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(node: int, who: np.ndarray) -> None:
            parts = self.nodes[node]
            if len(parts) == 2:
                own = self.order[parts[0] : parts[1]]
                row, point = np.nonzero(queries[who] @ self.points[own].T >= (1 - reach[who] ** 2 / 2 - _BAND)[:, None])
                pairs.append((who[row], own[point]))
                return
            vantage, near, a, b, rest, c, e = parts
            d = distances(queries[who], vantage)
            for child, low, high in ((near, a, b), (rest, c, e)):
                go = who[np.maximum(0, np.maximum(low - d, d - high)) * factor <= reach[who] + 2 * math.sqrt(_BAND)]
                if len(go):
                    visit(child, go)

        visit(0, np.arange(len(queries)))
        return np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first component as the final scores are."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * points @ to))


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``df`` under the condition ``is_query`` the k rows
    of largest cosine among all rows with another id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do ids
    that are null or no integers; rows of a repeated id count once (the smallest vector); vectors of different lengths are not
    compared; ties go to the smaller id; other columns are
    not read; an empty table, or one without queries, gives no rows.  Scores are dot product by
    the product of norms, in double precision, summed from the first component.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).try_cast("long").alias("id"), vector.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    )
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    # of equal vectors no query can find more than the k + 1 smallest ids
    copies = Window.partitionBy("v").orderBy("id")
    indexed = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("id", "v")
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-rows.filter(is_query(F.col("id"))).count() // BLOCK_QUERIES))

    def deal(part: DataFrame, own: str, n_own: int, other: str, n_other: int, query: bool) -> DataFrame:
        salted = part.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"))
        return salted.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).withColumn("query", F.lit(query))

    points = deal(indexed, "shard", shards, "block", blocks, False)
    asked = deal(rows.filter(is_query(F.col("id"))), "block", blocks, "shard", shards, True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        query = pdf["query"].to_numpy()
        if query.all() or not query.any():
            return pd.DataFrame({"query_id": [], "id": []}).astype("int64")
        pdf = pdf.sort_values("id", ignore_index=True)
        query, ids = pdf["query"].to_numpy(), pdf["id"].to_numpy()
        exact = np.stack(pdf["v"].to_numpy())
        unit = exact / np.abs(exact).max(axis=1, keepdims=True)  # so that squares stay finite
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        tree, asked_ids, own_ids, asked_v, own_v = VPTree(unit[~query]), ids[query], ids[~query], exact[query], exact[~query]
        best, _ = tree.search(unit[query], k, factor, asked_ids, own_ids)
        out_query, out_id = [], []
        for begin in range(0, len(asked_ids), BAND_QUERIES):
            q, p = tree.within(unit[query][begin : begin + BAND_QUERIES], best[begin : begin + BAND_QUERIES, -1], factor)
            q = q + begin
            other = asked_ids[q] != own_ids[p]
            q, p = q[other], p[other]
            with np.errstate(all="ignore"):
                score = np.empty(len(q))
                for x in range(0, len(q), 1 << 16):
                    i, j = q[x : x + (1 << 16)], p[x : x + (1 << 16)]
                    v, w = asked_v[i], own_v[j]
                    score[x : x + len(i)] = summed(v, w) / (np.sqrt(summed(v, v)) * np.sqrt(summed(w, w)))
            score[np.isnan(score)] = np.inf  # Spark puts them first
            by = np.lexsort((own_ids[p], -score, q))
            q, p = q[by], p[by]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out_query.append(asked_ids[q[keep]])
            out_id.append(own_ids[p[keep]])
        return pd.DataFrame({"query_id": np.concatenate(out_query), "id": np.concatenate(out_id)})

    columns = ["shard", "block", "query", "id", "v"]
    near = points.select(columns).unionByName(asked.select(columns)).groupBy("shard", "block", F.size("v").alias("length")).applyInPandas(run, "query_id long, id long")
    scored = near.join(rows, "id").join(rows.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    score = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
