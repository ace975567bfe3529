"""Hard-negative mining by angular triangle filtering.

Each row is stored with its norm and its angles to REFERENCES directions (picked far from each other out of SAMPLE rows). By the triangle
inequality of angles, the angle of two rows lies between the largest difference and the least sum of theirs; its cosine times both norms
bounds their score, with slack for rounding. Only rows whose bounds overlap a window of scores are scored, on whole numbers.

Rows are dealt to shards by their nearest reference, and by a hash of the id where a reference has more than a shard's bytes of rows.
Shards, and within them blocks of BLOCK rows along the angle, carry the least and largest angles and norms of their rows, so bounds hold for
them as well. An anchor first visits its own shard and then, with the k-th scores found there, those whose bounds still overlap.
Positives are one window, from the k-th score up; negatives one for each positive.

Defined results: rows with a null id, label, vector, or null or non-finite component take no part; shorter vectors count as padded with zeros;
repeated ids are rows each, but the least (label, vector) of them asks, and none is a positive or negative of its own id; products beyond
a long are clipped to its range; fewer positives or negatives than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, stored
from .exact_search import SCALE, _floored, whole_part
from .kdtree import Best

EVERY, RELABEL, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # per cent of the positive's score
REFERENCES, SAMPLE = 16, 256
SHARD_BYTES = 64 << 20
#: Bytes of shards' bounds that a task may hold; beyond, anchors visit all shards.
ROUTING_BYTES = 32 << 20
BLOCK, TURN_BLOCKS = 128, 32
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LIMIT = 2**63 - 1


def reference_directions(sample: np.ndarray) -> np.ndarray:
    """Up to REFERENCES unit rows of sample, each the farthest from those before; the axes' diagonal if there is none."""
    unit = _units(sample)[0]
    unit = unit[np.abs(unit).sum(axis=1) > 0]
    if not len(unit):
        return np.full((1, sample.shape[1]), 1 / np.sqrt(max(sample.shape[1], 1)))
    picked, nearest = [0], unit @ unit[0]
    while len(picked) < min(REFERENCES, len(unit)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    return unit[picked]


def _units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms, without leaving a double's range on the way; zero rows stay zero."""
    top = np.abs(points).max(axis=1, initial=0.0)
    scaled = points / np.where(top > 0, top, 1.0)[:, None]
    length = np.sqrt((scaled**2).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / np.where(length > 0, length, 1.0)[:, None], top * length


def score_bounds(angles: np.ndarray, norm: float, least: np.ndarray, largest: np.ndarray, least_norm: np.ndarray, largest_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of one row with rows whose angles and norms lie between those given (a row for each group of rows)."""
    apart = np.maximum(np.maximum(angles - largest, least - angles).max(axis=1) - ANGLE_SLACK, 0.0)
    around = np.minimum(angles + largest, 2 * np.pi - angles - least).min(axis=1)
    around = np.minimum(around + ANGLE_SLACK, np.pi)
    high, low = np.cos(np.minimum(apart, np.pi)), np.cos(around)
    with np.errstate(over="ignore", invalid="ignore"):
        most = norm * np.where(high > 0, largest_norm, least_norm) * high
        fewest = norm * np.where(low > 0, least_norm, largest_norm) * low
        slack = SCORE_SLACK * norm * largest_norm + 1.0
        most, fewest = most + slack, fewest - slack
    return np.where(np.isnan(fewest), -np.inf, fewest), np.where(np.isnan(most), np.inf, most)


class AngleIndex:
    """The rows of a shard, along the angle to its reference, in blocks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        order = np.argsort(angles[:, angles.mean(axis=0).argmin()], kind="stable") if len(ids) else np.arange(0)
        self.ids, self.labels, self.vectors, self.norms, self.angles = ids[order], labels[order], vectors[order], norms[order], angles[order]
        self.points = np.ascontiguousarray(_floored(self.vectors))
        self.largest = float(np.abs(self.points).max(initial=0.0))
        starts = np.arange(0, len(ids), BLOCK)
        self.box = tuple(f.reduceat(x, starts, axis=0) if len(starts) else x for f, x in ((np.minimum, self.angles), (np.maximum, self.angles), (np.minimum, self.norms), (np.maximum, self.norms)))
        self.scored = 0

    def _scores(self, rows: np.ndarray, raw: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        if self.largest * float(np.abs(q).max(initial=0.0)) * max(len(q), 1) < 2**53:
            return self.points[rows] @ q
        whole = [whole_part(x) for x in raw.tolist()]
        return np.array([max(-LIMIT, min(LIMIT, sum(whole_part(x) * y for x, y in zip(p, whole)))) for p in self.vectors[rows].tolist()] or [], dtype=object)

    def search(self, anchor: int, label: int, raw: np.ndarray, norm: float, angles: np.ndarray, windows: list[tuple[int, int]], k: int, same_label: bool) -> list[Best]:
        """For each window of scores, the k best rows of the anchor's label, or of all others."""
        found = [Best(k, low) for low, _ in windows]
        if not windows or not len(self.ids):
            return found
        q = _floored(raw)
        low, high = score_bounds(angles, norm, *self.box)
        blocks = np.argsort(-high, kind="stable")
        at, step = 0, 2  # few blocks first, so that the k-th score is soon high
        while at < len(blocks):
            now = blocks[at : at + step]
            at, step = at + step, min(2 * step, TURN_BLOCKS)
            open_ = _overlap(low[now], high[now], found, windows)
            if not open_.any():
                continue
            rows = (now[open_][:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(self.ids)]
            rows = rows[((self.labels[rows] == label) == same_label) & (self.ids[rows] != anchor)]
            if not len(rows):
                continue
            own = self.angles[rows]
            rows = rows[_overlap(*score_bounds(angles, norm, own, own, self.norms[rows], self.norms[rows]), found, windows)]
            scores, ids = self._scores(rows, raw, q), self.ids[rows]
            for best, (_, top) in zip(found, windows):
                fits = scores <= top
                best.add(scores[fits], ids[fits])
        return found


def _overlap(low: np.ndarray, high: np.ndarray, found: list[Best], windows: list[tuple[int, int]]) -> np.ndarray:
    hit = np.zeros(len(low), dtype=bool)
    for best, (_, top) in zip(found, windows):
        hit |= (high >= float(best.floor) * (1 - np.sign(float(best.floor)) * 1e-12)) & (low <= float(top) * (1 + np.sign(float(top)) * 1e-12))
    return hit


def measured(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """id, label, v, norm, angles, home (the nearest reference)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, references.shape[1])
            unit, norm = _units(_floored(v))
            angles = np.arccos(np.clip(unit @ references.T, -1.0, 1.0))
            columns = [b["id"], b["label"], b["v"], pa.array(norm), list_array(list(angles), pa.float64()), pa.array(angles.argmin(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "norm", "angles", "home"])

    return rows.mapInArrow(measure, "id long, label long, v array<double>, norm double, angles array<double>, home int")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def _answer(messages: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """messages: rows (kind 0) and anchors (kind 1) with the shard they go to. anchor_id, place (of the window), id, score."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_now, parts, index = -1, [], None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            shard, kind, ids, labels = (b[c].to_numpy() for c in ("shard", "kind", "id", "label"))
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            norm, angles = b["norm"].to_numpy(), _matrix(b["angles"], n)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), n]):
                if shard[a] != shard_now:
                    shard_now, parts, index = shard[a], [], None
                if kind[a] == 0:
                    parts.append([x[a:z] for x in (ids, labels, v, norm, angles)])
                    continue
                if index is None:
                    empty = [[ids[:0], labels[:0], v[:0], norm[:0], angles[:0]]]
                    index, parts = AngleIndex(*(np.concatenate(x) for x in zip(*(parts or empty)))), []
                out: list[tuple] = []
                for i, lows, highs in zip(range(a, z), b["lows"].slice(a, z - a).to_pylist(), b["highs"].slice(a, z - a).to_pylist()):
                    found = index.search(int(ids[i]), int(labels[i]), v[i], float(norm[i]), angles[i], list(zip(lows, highs)), k, same_label)
                    out += [(int(ids[i]), place, x, int(s)) for place, best in enumerate(found) for x, s in zip(best.ids.tolist(), best.scores.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "place", "id", "score"])

    return messages.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(stream, "anchor_id long, place int, id long, score long")


def _routes(bounds: dict[str, np.ndarray] | None, shards: int):
    """Column of the shards other than an anchor's own whose bounds overlap one of its windows."""

    def route(shard: pa.Array, norm: pa.Array, angles: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        own, out = shard.to_numpy(), []
        table = _matrix(angles, len(own))
        for i, (x, low_ends, high_ends) in enumerate(zip(norm.to_pylist(), lows.to_pylist(), highs.to_pylist())):
            low, high = score_bounds(table[i], x, bounds["least"], bounds["largest"], bounds["least_norm"], bounds["largest_norm"])
            windows = list(zip(low_ends, high_ends))
            hit = _overlap(low, high, [Best(1, a) for a, _ in windows], windows) if windows else np.zeros(len(low), dtype=bool)
            named = bounds["shard"][hit]
            out.append(named[named != own[i]].astype(np.int32))
        return list_array(out, pa.int32())

    if bounds is None:
        return F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
    return F.arrow_udf(route, "array<int>")("shard", "norm", "angles", "lows", "highs")


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rows: id, label, v. anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors with an id divisible by every."""
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    padded = rows.select("id", "label", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    sample = padded.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    references = reference_directions(_floored(np.array([r["v"] for r in sample], dtype=float).reshape(len(sample), width)))
    rows = stored(measured(padded, references), "angles")
    most = max(1, shard_bytes // (8 * (2 * width + len(references) + 3)))
    sizes = dict(rows.groupBy("home").count().collect())  # a row a reference
    pieces = [-(-sizes.get(i, 0) // most) for i in range(len(references))]
    before = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    of = lambda values: F.array(*map(F.lit, values))[F.col("home")]
    rows = rows.withColumn("shard", (of(before) + F.pmod(F.xxhash64("id", "v"), F.greatest(of(pieces), F.lit(1)))).cast("int")).drop("home")
    shards, bounds = before[-1], None
    if shards * (2 * len(references) + 3) * 8 <= ROUTING_BYTES:
        each = range(len(references))
        lists = F.array(*(F.min(F.col("angles")[i]) for i in each)).alias("least"), F.array(*(F.max(F.col("angles")[i]) for i in each)).alias("largest")
        told = rows.groupBy("shard").agg(*lists, F.min("norm").alias("least_norm"), F.max("norm").alias("largest_norm")).collect()
        bounds = {c: np.array([r[c] for r in told]) for c in ("shard", "least", "largest", "least_norm", "largest_norm")} if told else None
    no = F.lit(None).cast("array<long>")
    points = rows.select("shard", F.lit(0).alias("kind"), "id", "label", "v", "norm", "angles", no.alias("lows"), no.alias("highs"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "norm", "angles", "shard")).alias("a")).select("id", "a.*")
    kind = F.lit(1).alias("kind")

    def best_of(asking: DataFrame, k: int, same_label: bool) -> DataFrame:
        """asking: anchors with lows and highs. The k best of each window over all shards."""
        first = stored(_answer(points.unionByName(asking.select(*points.columns[:1], kind, *points.columns[2:])), width, k, same_label), "own-shard")
        found = first
        if shards > 1:
            reached = first.groupBy("anchor_id", "place").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            reached = reached.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("reached"))  # a window each
            raised = F.transform("lows", lambda low, i: F.coalesce(F.greatest(low, F.col("reached")[i]), low))
            sent = asking.join(reached, "id", "left").withColumn("lows", raised).drop("reached")
            sent = sent.withColumn("to", F.explode(_routes(bounds, shards))).drop("shard").withColumnRenamed("to", "shard")
            found = first.unionByName(_answer(points.unionByName(sent.select("shard", kind, *points.columns[2:])), width, k, same_label))
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    asking = asked.withColumn("lows", F.array(F.lit(-LIMIT))).withColumn("highs", F.array(F.lit(LIMIT)))
    pairs = stored(best_of(asking, positives, True).select("anchor_id", "rank", "id", "score"), "positives")
    own = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive"), "score"))).alias("p"))
    percent = lambda x, p: F.floor(x.cast("decimal(38,0)") * p / 100).cast("long")
    lows = F.transform("p", lambda x: -percent(-x["score"].cast("decimal(38,0)"), LEAST))
    asking = asked.join(own, "id").withColumn("lows", lows).withColumn("highs", F.transform("p", lambda x: percent(x["score"], MOST))).drop("p")
    found = best_of(asking, negatives, False).withColumn("positive_rank", F.col("place") + 1)
    named = pairs.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """id, label, v: rows that take part."""
    label = F.col("label") if label is None else label
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def hard_negatives(embeddings: DataFrame, every: int = EVERY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The digest of the query: labels of every RELABELth id move on by one before mining."""
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(usable(embeddings, moved), every, shard_bytes=shard_bytes)


ORACLE_SQL = f"""
with usable as (
  select vec_id, (case when vec_id % {RELABEL} = 0 then (label + 1) % {LABELS} else label end)::bigint as label,
         list_transform(embedding, lambda x: floor({SCALE:.0f} * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as anchor_id, c.vec_id, c.label = q.label as same, list_inner_product(q.v, c.v)::bigint as score
  from usable q, usable c where q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from pairs where same) where n <= {POSITIVES}),
windows as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank
  from positives p join pairs n on n.anchor_id = p.anchor_id and not same
  where {LEAST} * positive_score <= 100 * score and 100 * score <= {MOST} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from windows where rank <= {NEGATIVES}
"""
