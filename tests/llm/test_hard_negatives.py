"""Hard negatives against plain scores of all pairs."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencespark.llm import hard_negatives
from evidencespark.llm.queries import op12_hard_negatives

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import difference  # noqa: E402


def whole(x):
    return math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256


def slow(rows):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [whole(x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    limit, out, asked = 2**63 - 1, [], set()
    for anchor, label, q in sorted(rows):
        if anchor % 50 or anchor in asked:
            continue
        asked.add(anchor)
        scored = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(q, v)))), i, lab) for i, lab, v in rows if i != anchor)
        for s, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, i) for n, i, lab in scored if lab != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(anchor, positive, rank, i, -s, -n) for rank, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def test_sql(spark, sf):
    assert difference(spark, op12_hard_negatives, hard_negatives.ORACLE_SQL, sf) == ""


@pytest.mark.parametrize("shard_bytes", [64 << 20, 20_000])
def test_against_all_pairs(spark, shard_bytes, monkeypatch):
    """Clusters, a vector that a third of the rows have, zero vectors, nulls, repeated ids, short vectors; one shard for each reference or many."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = [(i, int(rng.integers(0, 10)), (centres[i % 6] + rng.standard_normal(12) * 0.2).tolist()) for i in range(900)]
    rows[300:600] = [(i, i % 3, rows[300][2]) for i in range(300, 600)]
    rows += [(950, 1, [0.0] * 12), (951, 1, None), (952, None, [1.0] * 12), (None, 1, [1.0] * 12), (953, 2, [1.0, None]), (1000, 3, [float("nan")] * 12), (1050, 3, [2.0, -1.0]), (100, 2, [0.5] * 12), (7, 3, [-0.5] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "shard": F.lit(0), "v": F.lit(1)})
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, shard_bytes=shard_bytes).collect())
    assert got == slow(rows)
    if shard_bytes < 1 << 20:
        monkeypatch.setattr(hard_negatives, "ROUTING_BYTES", 0)
        assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, shard_bytes=shard_bytes).collect()) == got
    assert hard_negatives.hard_negatives(frame.where("vec_id < 0")).count() == 0


def test_large_components(spark):
    rows = [(0, 1, [1e12, 3.0]), (1, 1, [1e12, 1.0]), (2, 2, [8e11, 2.0]), (3, 2, [3e38, 1.0]), (4, 1, [1e308, -1e308]), (50, 1, [1e5, 2e7]), (51, 1, [1e5, -2e3]), (52, 3, [6e4, -1e3]), (53, 4, [9e5, 2e6])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame).collect()) == slow(rows)


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24)) * 3
    v = (centres[rng.integers(0, 8, 4000)] + rng.standard_normal((4000, 24)) * 0.1)
    points = hard_negatives._floored(v)
    references = hard_negatives.reference_directions(points[:256])
    unit, norm = hard_negatives._units(points)
    angles = np.arccos(np.clip(unit @ references.T, -1, 1))
    scores = points @ points[7]
    low, high = hard_negatives.score_bounds(angles[7], norm[7], angles, angles, norm, norm)
    assert (low <= scores).all() and (scores <= high).all()
    index = hard_negatives.AngleIndex(np.arange(4000), np.zeros(4000, dtype=int), v, norm, angles)
    best = index.search(7, 0, v[7], norm[7], angles[7], [(-(2**62), 2**62)], 5, True)[0]
    order = np.lexsort((np.arange(4000), -scores))
    assert best.ids.tolist() == [i for i in order.tolist() if i != 7][:5] and index.scored < 3000
