"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Two Gaussians, one a class, are fitted to the statistics of doc_stats. Their covariances are shrunk
towards the identity of the standardised space; the inverse Cholesky factor of each is computed once
and kept in the model, and a score is the logistic of the difference of the two Mahalanobis
log-densities plus the log prior odds.

Moments are summed over all labelled rows on the executors; only 2 x (1 + d + d*d) sums reach the driver.

Defined results: null text scores as an empty one; labels other than 0 or 1 are left out; a repeated
document gets a row each time; with one class among the labels the score is that class, with none 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, each_text, list_array, stored
from .doc_stats import FEATURES, text_statistics

THRESHOLD = 0.3
SHRINKAGE = 0.05
#: Labels that the filter of a corpus is fitted on, at most; the scoring of documents reads all of them.
FIT_ROWS = 20_000
D = len(FEATURES)


@dataclass(frozen=True)
class QdaModel:
    """mean, scale: of the standardised space. For classes 0 and 1: centre, inverse Cholesky factor, log constant."""

    mean: np.ndarray
    scale: np.ndarray
    centres: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.mean) / self.scale
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centres, self.factors, self.constants)]
        return np.round(1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))), 9)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(text: pa.Array) -> pa.Array:
    return list_array([np.array(text_statistics(t)) for t in each_text(text)], pa.float64())


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its whole text, stored: training and scoring read them, the text is read once."""
    return stored(docs.select("doc_id", statistics("text").alias("stats")), "quality-stats")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros((2, 1 + D + D * D))
    for pdf in batches:
        if len(pdf):
            x, y = np.stack(pdf["stats"].to_numpy()), pdf["quality"].to_numpy()
            for c in (0, 1):
                a = x[y == c]
                sums[c] += np.concatenate([[len(a)], a.sum(axis=0), (a.T @ a).ravel()])
    for c in (0, 1):
        yield pd.DataFrame({"quality": c, "pos": np.arange(sums.shape[1]), "value": sums[c]})


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> QdaModel:
    """labelled: stats array<double>, quality 0 or 1."""
    rows = labelled.select("stats", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and stats is not null")
    sums = np.zeros((2, 1 + D + D * D))
    with bounded_batches(labelled.sparkSession):
        found = rows.mapInPandas(_moments, "quality int, pos int, value double").groupBy("quality", "pos").agg(F.sum("value").alias("value")).collect()
    for r in found:
        sums[r["quality"], r["pos"]] = r["value"]
    n = sums[:, 0]
    if not n.all():
        only = 0.5 if not n.any() else float(n[1] > 0)
        return QdaModel(np.zeros(D), np.ones(D), (), (), (), only)
    total = sums.sum(axis=0)
    mean = total[1 : 1 + D] / total[0]
    scale = np.sqrt(np.maximum(np.diag(total[1 + D :].reshape(D, D)) / total[0] - mean**2, 0)) + 1e-3
    centres, factors, constants = [], [], []
    for c in (0, 1):
        m = sums[c, 1 : 1 + D] / n[c]
        cov = (sums[c, 1 + D :].reshape(D, D) / n[c] - np.outer(m, m)) / np.outer(scale, scale)
        a = max(shrinkage, D / (n[c] + D))  # few rows of a class: nearer to the identity
        chol = np.linalg.cholesky(np.round((1 - a) * cov + a * np.eye(D), 9))
        centres.append(np.round((m - mean) / scale, 9))
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(n[c] / total[0]) - np.log(np.diag(chol)).sum()))
    return QdaModel(mean, scale, tuple(centres), tuple(factors), tuple(constants))


def held_out() -> F.Column:
    """True for the fifth of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    stats = with_statistics(docs)
    known = labels.select("doc_id", "quality").where(~held_out())
    model = fit(stats.join(known, "doc_id").select("stats", "quality"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    scored = stats.select("doc_id", held_out().alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged. The fit reads the documents of at most fit_rows labels, chosen
    by a hash of their id; the filter computes the statistics of each document in the pass that writes the result."""
    known = labels.select("doc_id", "quality").where(~held_out() & F.col("quality").isin(0, 1))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    model = fit(texts.select(statistics("text").alias("stats"), "quality"))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([text_statistics(t) for t in each_text(text)]).reshape(-1, D)) >= threshold, pa.bool_())

    return stored(docs.where(good("text")), "quality-kept")
