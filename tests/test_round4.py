"""Cases of the findings of round 4."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidencespark.operators import assign, works
from evidencespark.plans import queries, report_queries  # noqa: F401
from evidencespark.plans.registry import QUERIES

DAY = datetime.date(2020, 1, 1)
CERTS, WORKS = "cert long, name string, entity string, day date", "work long, name string, entity string, start date"


def shuffle_bytes(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def linked_by_all_pairs(certs, registry, level):
    words = lambda t: sorted({*(t or "").upper().split()})
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    n = Counter(w for r in registry for w in words(r[1]))
    out = {}
    for cert in {c[0] for c in certs}:
        rows = [c for c in certs if c[0] == cert]
        known = sorted(((n[w], w) for r in rows for w in words(r[1]) if n[w]))
        keys = {w for _, w in known[:2]} if level == 1 else {w for _, w in known}
        found = []
        for _, name, entity, day in rows:
            for work, other, owner, start in registry:
                held = keys & {*words(other)}
                if keys and (held == keys if level == 1 else held):
                    days = (day - start).days if day and start else None
                    near = 0.0 if days is None or days > 3650 else -10.0 if days < 0 else max(0.0, 30 - days / 365 * 3)
                    found.append((-round(50 * jaccard(words(name), words(other)) + near + 20 * jaccard(words(entity), words(owner)), 6), work))
        found.sort()
        if found and -found[0][0] >= 15:
            out[cert] = (found[0][1], -found[0][0], len(found) > 1 and found[1][0] - found[0][0] < 5)
    return out


@pytest.mark.parametrize("level", [1, 3])
def test_links_by_classes_equal_all_pairs(spark, level):
    rng = random.Random(level)
    names = ["red bolt", "bolt red", "Red  gear", "blue bolt", "red bolt gear", "zinc", "", None]
    entities = ["Brand 1", "Brand 2", "brand 1", "MTC", "", None]
    ages = [None, 0, 1, 364, 365, 3649, 3650, 3651, 5000, -1, -300]
    back = lambda: (a := rng.choice(ages)) is not None and DAY - datetime.timedelta(a + rng.choice((0, 0, 1, 700))) or None
    registry = [(i, rng.choice(names), rng.choice(entities), back()) for i in range(90)]
    certs = [(i // 2 if i < 60 else i, rng.choice([*names, "unknown red"]), rng.choice(entities), rng.choice((DAY, DAY, None, back()))) for i in range(160)]
    certs += certs[:4]  # the same row twice in a certificate
    got = works.link_works(spark.createDataFrame(certs, CERTS), spark.createDataFrame(registry, WORKS), "cert", "work", levels=(level,)).collect()
    want = linked_by_all_pairs(certs, registry, level)
    assert {r["cert"]: (r["work"], pytest.approx(r["score"], abs=2e-6), r["ambiguous"]) for r in got} == want
    assert len(got) == len(want) > 50


def test_certificates_do_not_meet_each_work_of_their_name(spark):
    """600 certificates and 2,000 works of one name, on days and starts of their own: 1,200,000 pairs before."""
    ago = lambda k: DAY - datetime.timedelta(k)
    registry = [(i, "red bolt", f"Brand {i % 4}", ago(i)) for i in range(2000)]
    certs = [(i, "red bolt", f"Brand {i % 3}", ago(i)) for i in range(600)]
    began = shuffle_bytes(spark)
    got = works.link_works(spark.createDataFrame(certs, CERTS), spark.createDataFrame(registry, WORKS), "cert", "work", levels=(1,)).collect()
    moved = shuffle_bytes(spark) - began
    assert {r["cert"]: r["work"] for r in got} == {i: next(w for w in range(i, i + 4) if w % 4 == i % 3) for i in range(600)}
    assert moved < 2_000_000, moved


def test_linking_sends_no_growing_table_whole(spark, monkeypatch):
    plans, stored = [], works.stored
    monkeypatch.setattr(works, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    QUERIES["link_candidates_top1"](spark, "/root/testdata/sf0.001")
    assert len(plans) > 5 and not [name for name, plan in plans if "BroadcastHashJoin" in plan]


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_pairs_of_tiles_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(assign, "PAIR_TILE", tile)
    rng = random.Random(tile)
    texts = ["red bolt", "RED  bolt", "bolt red", "red", "blue rod", "zinc", "", None, "ñu red rod"]
    rows = [(rng.choice((*range(40), None)), rng.choice(("x", "y", None)), rng.choice(texts)) for _ in range(70)]
    words = lambda t: {*(t or "").upper().replace("Ñ", "N").split()}
    want = Counter()
    for a, g, s in rows:
        for b, h, t in rows:
            x, y = words(s), words(t)
            if None not in (a, b, g) and a < b and g == h and x & y:
                want[a, b, round(len(x & y) / len(x | y), 6), round(len(x & y) / max(len(x), len(y)), 6)] += 1
    got = assign.pairs_sharing_words(spark.createDataFrame(rows, "k int, g string, t string"), "g", "k", "t", 6)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_one_text_s_pairs_are_dealt_over_tasks_and_not_moved(spark):
    rows = spark.range(4000).select("id", F.lit("x").alias("g"), F.concat(F.lit("red "), F.col("id") % 2 * F.col("id") % 50).alias("t"))
    began = shuffle_bytes(spark)
    pairs = assign.pairs_sharing_words(rows, "g", "id", "t").groupBy(F.spark_partition_id().alias("p")).count()
    parts = dict(map(tuple, pairs.collect()))
    assert sum(parts.values()) == 4000 * 3999 // 2
    assert len(parts) == 4 and max(parts.values()) < 0.4 * sum(parts.values())  # all in one task before
    assert shuffle_bytes(spark) - began < 2_500_000
