"""Regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (:data:`STATISTICS`), log-transformed.  Per class, a
mean and a covariance shrunk towards the pooled diagonal are made from sums of
the vectors and of their products; sums merge, so all labelled rows count and none are
gathered.  The model keeps each covariance's Cholesky factor; a score is the logistic of
the tempered difference of the two classes' log densities, whose quadratic terms are
Mahalanobis distances solved through the factors.

Edge cases: null and empty texts have a vector of zeros and so a score; rows with null
labels are not learnt from; with fewer than two rows of a class the score is the share of
label 1, (n1 + 1) / (n + 2), for all; repeated label rows count each; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import byte_sizes, drop_own, extend_schema, materialize, slices, with_columns
from .quality_rules import measure_texts, repeated

STATISTICS = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "distinct", "same_as_last", "stops", "line_words"]
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b".,;:"], 1):
    _CLASS[list(_chars)] = _i


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text."""
    data, offsets = textscan.buffer_of(texts)
    got = {k: v.astype(np.float64) for k, v in measure_texts(texts).items()}
    words = textscan.words(data, offsets)
    n = got["n_words"]
    one = n + 8  # a few words alone say little
    kinds = np.array([np.bincount(_CLASS[data[a:b]], minlength=5) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64).reshape(-1, 5)
    chars = got["word_chars"] + 40
    again = repeated(words.hash, words.row)
    follows = np.zeros(len(words.hash), dtype=bool)
    follows[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    per_row = lambda flags: np.bincount(words.row[flags], minlength=len(n))
    lines = np.array([np.count_nonzero(data[a:b] == 10) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64)
    return np.column_stack([
        np.log1p(n),
        np.log1p(got["word_chars"] / np.maximum(n, 1)),
        np.log1p(20 * got["n_symbols"] / one),
        np.log1p(20 * got["n_dup_lines"] / one),
        np.log1p(10 * got["n_repeat_words"] / one),
        np.log1p(10 * kinds[:, 1] / chars),
        np.log1p(20 * kinds[:, 2] / one),
        np.log1p(10 * kinds[:, 3] / chars),
        np.log1p(3 * per_row(again) / one),
        np.log1p(20 * per_row(follows) / one),
        np.log1p(5 * kinds[:, 4] / one),
        np.log1p(n / np.maximum(lines, 1)),
    ])


def _vectors(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = batch.column(at)
    for a, b in slices(byte_sizes(texts), 2 << 20):
        yield a, b, statistics(texts.slice(a, b - a))


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, x): the statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _vectors(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=[id_col, "x"])

    inner = docs.select(id_col, text_col)
    return inner.mapInArrow(run, extend_schema(inner.select(id_col), ("x", T.ArrayType(T.DoubleType()))))


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # of the two classes
    factors: np.ndarray  # lower Cholesky factors of their covariances
    offset: float  # log prior ratio and half the difference of log determinants
    temper: float
    share: float | None = None  # the constant score, where a class is missing

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        far = [np.square(np.linalg.solve(f, (z - m).T)).sum(0) for f, m in zip(self.factors, self.means, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.temper * (0.5 * (far[0] - far[1]) + self.offset), -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of (y, x) rows: for each class the count, sum and sum of products."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(0))
                x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
                for c in (0, 1):
                    own = x[y == c]
                    held[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        at = np.flatnonzero(held.ravel())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], names=["k", "v"])

    sums = np.zeros(2 * (1 + d + d * d))
    for r in labelled.select("y", "x").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row a cell
        sums[r.k] = r.v
    return {c: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in enumerate(sums.reshape(2, -1))}


def fit(labelled: DataFrame, shrink: float = 0.3, ridge: float = 0.05, temper: float = 0.5) -> Discriminant:
    """From (y, x) rows; ``shrink`` mixes in the pooled diagonal, ``ridge`` is added to it."""
    by = moments(labelled)
    d, total = len(STATISTICS), by[0][0] + by[1][0]
    if min(by[0][0], by[1][0]) < 2:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.array([np.eye(d)] * 2), 0.0, temper, (by[1][0] + 1) / (total + 2))
    centre = (by[0][1] + by[1][1]) / total
    scale = np.sqrt(np.maximum((np.diag(by[0][2]) + np.diag(by[1][2])) / total - centre**2, 0)) + 1e-3
    means = np.array([by[c][1] / by[c][0] for c in (0, 1)])
    spread = [(by[c][2] / by[c][0] - np.outer(means[c], means[c])) / np.outer(scale, scale) for c in (0, 1)]
    pooled = np.diag(sum(by[c][0] * spread[c] for c in (0, 1)) / total)
    factors = np.array([np.linalg.cholesky((1 - shrink) * spread[c] + shrink * np.diag(pooled) + ridge * np.eye(d)) for c in (0, 1)])
    logdet = [2 * np.log(np.diag(f)).sum() for f in factors]
    return Discriminant(centre, scale, (means - centre) / scale, factors, float(np.log(by[1][0] / by[0][0]) - 0.5 * (logdet[1] - logdet[0])), temper)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """From :func:`vectors` and labels, without the held-out fifth."""
    y = labels.where(F.col(label_col).isin(0, 1)).where(~held_out(id_col)).select(id_col, F.col(label_col).cast("bigint").alias("y"))
    return fit(found.join(y, id_col))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of each row."""
    found = materialize(vectors(docs, id_col, text_col), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(found, labels, id_col, label_col))  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=[id_col, "score"])

    scored = found.mapInArrow(run, extend_schema(found.select(id_col), ("score", T.DoubleType())))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    inner = drop_own(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = inner.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _vectors(batch, at):
                yield with_columns(batch.slice(a, b - a), score=pa.array(shared.value.score(x)))

    return inner.mapInArrow(run, extend_schema(inner, ("score", T.DoubleType()))).where(F.col("score") >= threshold).drop("score")
