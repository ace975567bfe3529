"""Exact top-k search by inner product: a KD-tree per shard, searched best first by box bounds.

A box bounds the inner product of a query with all points in it: each coordinate adds the larger of its two ends. The
search of a shard leaves out boxes below the k-th score known so far, which the query brings along from the shard it
visited first.

Vectors are turned into whole numbers, floor(256 * x). Products are exact: in double precision while all sums stay
below 2**53, otherwise in Python's integers, clipped to the range of a long. Components of any finite size take part.

Defined results: null vectors and such with null or non-finite components take no part; shorter vectors count as padded
with zeros; a row is not a candidate for queries of its own id; repeated ids are candidates each; fewer candidates than
k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import Best, KdTree, prepared, top_k

EVERY, K = 50, 5
SCALE = 256.0


def whole_part(x: float) -> int:
    """floor(256 * x), where 256 * x may be beyond a double's range."""
    return int(np.floor(x * SCALE)) if abs(x) < 2.0**53 else int(x) * int(SCALE)


def _floored(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, the largest double where that is beyond."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * SCALE))


class InnerProductIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        self.k, points = k, _floored(vectors)
        self.tree = KdTree(points)
        self.vectors = vectors
        self.ids, self.points = ids[self.tree.order], np.ascontiguousarray(points[self.tree.order])
        self.least_ids = [int(self.ids[a:b].min()) if b > a else 0 for a, b in zip(self.tree.start, self.tree.end)]
        self.largest = float(np.abs(points).max()) if points.size else 0.0

    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        raw, queries = queries, _floored(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            merits = np.maximum(queries, 0) @ self.tree.boxes_high.T + np.minimum(queries, 0) @ self.tree.boxes_low.T
        for query_id, q, own_raw, merit, floor in zip(ids.tolist(), queries, raw, merits, floors.tolist()):
            exact = self.largest * float(np.abs(q).max(initial=0.0)) * max(len(q), 1) < 2**53
            if not exact:  # a bound that is no number bounds nothing: such boxes are visited
                merit = np.where(np.isfinite(merit), merit + np.abs(merit) * 1e-9 + 1, np.inf)
                floor = floor - abs(floor) * 1e-12 if floor > -np.inf else floor
                whole = [whole_part(x) for x in own_raw.tolist()]
            best = Best(self.k, floor)

            def go_on(node: int) -> bool:
                return merit[node] > best.floor or merit[node] == best.floor and self.least_ids[node] <= best.worst_id

            for a, b in self.tree.best_first(merit, go_on):
                own = self.ids[a:b]
                if exact:
                    scores = self.points[a:b] @ q
                else:
                    limit, rows = 2**63 - 1, self.vectors[self.tree.order[a:b]].tolist()
                    scores = np.array([max(-limit, min(limit, sum(whole_part(x) * y for x, y in zip(p, whole)))) for p in rows], dtype=object)
                other = own != query_id
                best.add(scores[other], own[other])
            yield query_id, best.ids, best.scores


def exact_top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    found = top_k(prepared(embeddings, nonzero=False), every, k, lambda ids, v: InnerProductIndex(ids, v, k), "long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = f"""
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from usable q, usable c where q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= {K}
"""
