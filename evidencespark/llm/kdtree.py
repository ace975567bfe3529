"""KD-trees over one shard, and the job that brings queries to the shards.

Vectors are dealt to shards by a hash of their id: of LEAST_ROWS rows, and of more, up to SHARD_ROWS, where there would be over
SHARDS of them, as each query visits each shard. A task gets its shards one after the
other, a shard's vectors before its queries, as a stream of bounded batches; it keeps one shard's vectors and tree at a
time. Queries go first to their own shard and then, with the k-th score found there, to all the others: blocks of the
stated query set against all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_ROWS, SHARDS, SHARD_ROWS = 8192, 64, 65_536
LEAF_ROWS = 128


class KdTree:
    """Median splits on the widest side; each node has the tight bounding box of its points. Nodes are numbered from the
    root 0; left[i] is -1 at a leaf; a node's points are order[start[i]:end[i]]."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        todo = [(0, len(points), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            node = len(self.left)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            own = self.order[a:b]
            box = points[own]
            low, high = (box.min(axis=0), box.max(axis=0)) if b > a else (np.zeros(points.shape[1]),) * 2
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            self.start.append(a)
            self.end.append(b)
            if b - a > leaf_rows and len(low) and (high - low).max() > 0:
                axis, half = int((high - low).argmax()), (b - a) // 2
                self.order[a:b] = own[np.argpartition(box[:, axis], half)]
                todo += [(a + half, b, node, True), (a, a + half, node, False)]
            elif b - a > leaf_rows:  # equal points: cut by place, so that no leaf is large
                half = (b - a) // 2
                todo += [(a + half, b, node, True), (a, a + half, node, False)]
        self.boxes_low, self.boxes_high = np.array(self.low), np.array(self.high)

    def best_first(self, merit: np.ndarray, go_on: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
        """Leaves (as ranges of order) by falling merit; merit[i] bounds all points below node i. A node for which go_on is
        false is left out with all below it."""
        heap = [(-merit[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not go_on(node):
                continue
            if self.left[node] < 0:
                yield self.start[node], self.end[node]
            else:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-merit[child], child))


class Best:
    """The k best (score, id) so far: higher scores first, ties to the smaller id. floor: a score that k others reach."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.empty(0), np.empty(0, dtype=np.int64)
        self.worst_id = np.iinfo(np.int64).max

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = scores >= self.floor
        if not hit.any():
            return
        scores, ids = np.concatenate([self.scores, scores[hit]]), np.concatenate([self.ids, ids[hit]])
        if scores.dtype == object:  # whole numbers beyond what a double holds
            first = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k])
        else:
            first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k and self.scores[-1] >= self.floor:
            self.floor, self.worst_id = self.scores[-1], int(self.ids[-1])


class Searcher(Protocol):
    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its id, the ids and scores of its best candidates of this shard."""


def prepared(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """id, v: finite vectors as doubles, padded with zeros to the longest (found in the same pass over sizes)."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    return usable.where(F.exists("v", lambda x: x != 0)) if nonzero else usable


def top_k(vectors: DataFrame, every: int, k: int, make: Callable[[np.ndarray, np.ndarray], Searcher], score: str = "double", shard_rows: int | None = None) -> DataFrame:
    """vectors: id, v. Queries are the rows whose id is divisible by every. make(ids, vectors) builds a shard's index; score is double or long."""
    count, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shard_rows = shard_rows or min(SHARD_ROWS, max(LEAST_ROWS, count // SHARDS))
    shards = max(1, -(-count // shard_rows))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", padded.alias("v"))
    points = rows.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor"))
    asked = rows.where(F.col("id") % every == 0).groupBy("shard", "id").agg(F.min("v").alias("v"))  # of a repeated id, one vector asks

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, index = -1, [], [], None
        for batch in batches:
            shard, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            id_ = batch["id"].to_numpy()
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(shard), width)
            floor = np.nan_to_num(batch["floor"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, ids, parts, index = shard[a], [], [], None
                if kind[a] == 0:
                    ids.append(id_[a:b])
                    parts.append(v[a:b])
                    continue
                if index is None:
                    index = make(np.concatenate(ids) if ids else np.empty(0, dtype=np.int64), np.concatenate(parts) if parts else np.empty((0, width)))
                    ids, parts = [], []
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    found = [(np.full(len(i), q), i, s) for q, i, s in index.search(id_[c:d], v[c:d], floor[c:d])]
                    if found:
                        q, i, s = (np.concatenate(x) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64()) if score == "double" else pa.array([int(x) for x in s], pa.int64())], ["query_id", "vec_id", "score"])

    def run(queries: DataFrame) -> DataFrame:
        both = points.unionByName(queries)
        return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(stream, f"query_id long, vec_id long, score {score}")

    own = stored(run(asked.select("shard", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor"))), "own-shard")
    found = own
    if shards > 1:
        floors = own.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = floors.select("id", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("floor"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))).alias("other")
        sent = asked.join(floors, "id", "left").select(others, "id", "v", "floor")
        found = own.unionByName(run(sent.select(F.col("other").alias("shard"), F.lit(1).alias("kind"), "id", "v", "floor")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
