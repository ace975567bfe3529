"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner product is turned into least distance: vectors get one more coordinate that brings them all to the
largest norm, queries are scaled to it. A seeded Gaussian (2-stable) matrix projects both to DIMENSIONS coordinates;
the squared projected distance is the squared distance times a chi-square variable. A KD-tree per shard yields
neighbours in the projected space from the nearest on; each is verified by its inner product on the original vectors,
until the chi-square test holds: a point as near as the k-th found would have been met with probability CONFIDENCE
within the projected distance already covered. Every row is indexed; nothing is fitted to data but the largest norm.

Defined results: products beyond a double's range are infinite, in the order of the true ones; null, zero and non-finite vectors take no part; shorter vectors count as padded with zeros; a row is not
a candidate for queries of its own id; fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import Best, KdTree, prepared, top_k

EVERY, K = 20, 20
DIMENSIONS = 12
CONFIDENCE = 0.96
SEED = 2014
LEAF = 256


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number m of degrees of freedom."""

    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - above(mid) < p else (low, mid)
    return high


class ProjectionIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, k: int = K, confidence: float = CONFIDENCE, m: int = DIMENSIONS):
        self.k, self.norm2, self.reach = k, norm2, chi_square_quantile(confidence, m)
        self.matrix = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, m))
        lift = np.sqrt(np.maximum(norm2 - (vectors**2).sum(axis=1), 0))
        projected = np.column_stack([vectors, lift]) @ self.matrix
        self.tree = KdTree(projected, LEAF)
        self.ids, self.vectors = ids[self.tree.order], np.ascontiguousarray(vectors[self.tree.order])
        self.projected = np.ascontiguousarray(projected[self.tree.order])
        self.squares = (self.projected**2).sum(axis=1)

    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        low, high = self.tree.boxes_low, self.tree.boxes_high
        scales = np.sqrt(self.norm2) / np.sqrt((queries**2).sum(axis=1))
        projected = (queries * scales[:, None]) @ self.matrix[:-1]
        for query_id, q, scale, y, floor in zip(ids.tolist(), queries, scales.tolist(), projected, floors.tolist()):
            gap = np.maximum(np.maximum(low - y, y - high), 0)
            nearest = (gap**2).sum(axis=1)
            best = Best(self.k, floor)

            def radius() -> float:
                """Squared projected distance at which the stopping test holds for the k-th score known."""
                return math.inf if best.floor == -math.inf else self.reach * max(2 * self.norm2 - 2 * scale * best.floor, 0.0) + 1e-9

            for a, b in self.tree.best_first(-nearest, lambda node: nearest[node] <= radius()):
                near = self.squares[a:b] - 2 * (self.projected[a:b] @ y) + float(y @ y) <= radius()
                near &= self.ids[a:b] != query_id
                if near.any():
                    best.add((self.vectors[a:b][near] * q).sum(axis=1), self.ids[a:b][near])
            yield query_id, best.ids, best.scores


def approximate_top_k(embeddings: DataFrame, every: int = EVERY, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (the inner product in double precision)."""
    vectors = prepared(embeddings, nonzero=True)
    # Components so large or small that squares leave a double's range are brought near 1 by a power of two, which orders alike.
    largest = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    unit = 1.0 if 2.0**-400 < largest < 2.0**400 else 2.0 ** -max(-1020, min(1020, math.frexp(largest)[1]))
    vectors = vectors if unit == 1.0 else vectors.select("id", F.transform("v", lambda x: x * unit).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    norm2 = vectors.agg(F.max(square)).first()[0] or 1.0
    found = top_k(vectors, every, k, lambda ids, v: ProjectionIndex(ids, v, norm2, k, confidence))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") / unit / unit).alias("score"))
