"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds.  ``x``
holds the presence of hashed words and word beginnings; L1 shrinkage leaves most weights zero, so
long clean documents do not add up to anything.  The model is fitted on a bounded sample of the
labelled rows; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricetide.llm.common import slices, texts_of, tidy

#: Labelled documents the model is fitted on, at most (chosen by a hash of their id).
SAMPLE = 12_000
BUCKETS = 1 << 18
GRADES = 4
#: Letters of a word's beginning that make a feature, for longer words: inflected and compound forms share them.
BEGINNINGS = (4, 5)
_MARKS = "".join(map(chr, [*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: Words a task keeps the features of.
_CACHE = 200_000


class Features:
    """Feature buckets of texts; words met before are looked up."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[int, ...]] = {}

    def word(self, raw: str) -> tuple[int, ...]:
        got = self.of.get(raw)
        if got is None:
            if len(self.of) >= _CACHE:
                self.of.clear()
            w = raw.strip(_MARKS)
            names = [w] if w else []
            names += [w[:n] + "*" for n in BEGINNINGS if len(w) > n]
            got = self.of[raw] = tuple(xxhash.xxh3_64_intdigest(x) % BUCKETS for x in names)
        return got

    def text(self, text: str) -> np.ndarray:
        """The sorted distinct buckets of a text."""
        found: set[int] = set()
        for w in set(text.lower().split()):
            found.update(self.word(w))
        return np.array(sorted(found), np.int32)


def _rows_with(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each feature is, a few rows at a time."""
    out = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(rows), 256):
        out += np.bincount(np.concatenate(rows[k : k + 256]), minlength=BUCKETS)
    return out


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Ordered grades from yes/no labels: a toxic text's grade grows with the number of its features that
    the sample shows (almost) only in toxic texts: one up to two such features, then one more for
    each doubling, up to the top grade.  Texts that are not toxic have grade 0."""
    yes, no = (_rows_with([r for r, t in zip(rows, toxic, strict=True) if bool(t) == side]) for side in (True, False))
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    telling = (yes >= 5) & (yes / n_yes > 20 * (no + 0.5) / n_no)
    hits = np.array([telling[r].sum() for r in rows])
    return np.where(toxic > 0, np.clip(np.ceil(np.log2(np.maximum(hits, 2))), 1, grades - 1), 0).astype(np.int64)


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, l1: float = 0.9, rate: float = 0.5, rounds: int = 300, least_rows: int = 3, least_z: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by proximal AdaGrad on the mean log-likelihood.  The shrinkage
    is ``l1`` by the number of rows (a prior).  Features in fewer than ``least_rows`` rows, and those
    whose share of rows above grade 0 is within ``least_z`` standard errors of all rows', get no weight."""
    w, theta = np.zeros(BUCKETS), np.arange(1, grades, dtype=float)
    n = len(rows)
    if not n or grade.max() == 0:
        return w, np.full(grades - 1, 30.0)
    seen, high = _rows_with(rows), _rows_with([r for r, g in zip(rows, grade, strict=True) if g > 0])
    share = (grade > 0).mean()
    telling = np.abs(high - seen * share) >= least_z * np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    telling &= seen >= least_rows
    rows = [r[telling[r]] for r in rows]
    row, l1 = np.repeat(np.arange(n), [len(r) for r in rows]), l1 / n
    used, at = np.unique(np.concatenate(rows), return_inverse=True)
    v, g_w, g_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(grades - 1, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(rounds):
        s = np.bincount(row, v[at], minlength=n)
        edges = np.concatenate(([-1e9], theta, [1e9]))
        upper, lower = sigmoid(edges[grade + 1] - s), sigmoid(edges[grade] - s)
        width = np.maximum(upper - lower, 1e-9)
        slope = np.bincount(at, (1 - upper - lower)[row], minlength=len(used)) / n  # of the loss in w
        pull = np.bincount(grade, upper * (1 - upper) / width, minlength=grades)[: grades - 1] - np.bincount(grade, lower * (1 - lower) / width, minlength=grades)[1:]
        g_w += slope**2
        step = rate / np.sqrt(g_w)
        v = v - step * slope
        v = np.sign(v) * np.maximum(0, np.abs(v) - step * l1)
        g_t += (pull / n) ** 2
        theta = np.maximum.accumulate(theta + rate / np.sqrt(g_t) * pull / n + np.arange(grades - 1) * 1e-6)
    w[used] = v
    return w, theta


def sample_features(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most about ``limit`` labelled documents; of rows of one id, the smallest
    text and the highest label count, and ids that are no integers have none."""
    labels = labels.select(F.col(id_col).try_cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    n = labels.count()
    part = min(1.0, limit / max(1, n))
    chosen = labels.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(part * 1_000_000)).groupBy("_id").agg(F.max("_label").alias("_label"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "_text"):
            found = [features.text(t).tobytes() for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("_label")], names=["features", "label"])

    docs = df.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # the sample is bounded by ``limit``, so it may go to every executor; one text of each id
    taken = docs.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    got = taken.select("_text", "_label").mapInArrow(run, "features binary, label int").collect()
    got = sorted((bytes(r.features), r.label) for r in got)
    return [np.frombuffer(f, np.int32) for f, _ in got], np.array([y for _, y in got], np.int64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on yes/no labels.  Without labelled documents every text gets severity 0."""
    rows, toxic = sample_features(df, labels, id_col, text_col, label_col, limit)
    return fit(rows, severity_grades(rows, toxic) if len(rows) else toxic)


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``df`` with ``severity`` (expected grade), ``grade`` (most likely one) and ``toxic`` (grade 1 or
    more is at least as likely as not).

    Null, empty and blank texts have no features and get severity 0, grade 0.  Columns named like
    an added one are replaced; rows are kept one by one; an empty table gives none.
    """
    w, theta = model
    used = np.flatnonzero(w)
    small, theta = w[used].astype(np.float64), theta.astype(np.float64)
    df = df.drop("severity", "grade", "toxic")
    out = T.StructType([*df.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    arrow = to_arrow_schema(out)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(), np.zeros(BUCKETS)
        weights[used] = small
        for batch in slices(batches, text_col):
            found = [features.text(t) for t in texts_of(batch, text_col)]
            s = np.array([weights[f].sum() for f in found])
            over = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -40, 40)))  # P(grade >= k)
            over[[not len(f) for f in found]] = 0
            each = -np.diff(np.concatenate((np.ones((len(s), 1)), over, np.zeros((len(s), 1))), axis=1), axis=1)
            new = [pa.array(np.round(over.sum(axis=1), 9)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(arrow)[:-3]), *new], schema=arrow)

    return df.mapInArrow(run, out)
