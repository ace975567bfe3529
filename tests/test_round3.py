"""Cases of the findings of round 3."""

import random

import oracle
from pyspark.sql import functions as F

from evidencespark.operators import assign, markdown
from evidencespark.plans import queries, report_queries  # noqa: F401
from evidencespark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_contained_texts_equal_all_pairs(spark):
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("ab é\U0001f600") for _ in range(n))
    hay = [(g, made(rng.choice((0, 1, 3, 9, 40, 200)))) for g in (None, 1, 2) for _ in range(40)]
    needles = [(1, ""), (7, "x"), *((g, made(rng.randrange(70))) for g, _ in hay)]
    for g, t in hay:
        starts = [rng.randrange(len(t)) for _ in range(6)] if t else []
        needles += [(g, t[a : a + rng.choice((1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 63, 64, 150))]) for a in starts]
    n, h = (spark.createDataFrame(rows, "g int, t string") for rows in (needles, hay))
    got = assign.contained_texts(n, h, "g", "t")
    assert set(map(tuple, got.collect())) == {(g, x, y) for g, x in needles if x for k, y in hay if k == g and x in y}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()  # its index outgrows what the planner takes it for


def test_golden_rows_whose_keys_begin_alike(spark, tmp_path):
    p = spark.read.parquet(f"{SF}/part.parquet").limit(100).withColumns({"p_name": F.lit("red tan"), "p_brand": F.lit("B")})
    p.write.parquet(f"{tmp_path}/part.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["golden_missing_extra"]).fetchall())
    assert sorted(map(tuple, QUERIES["golden_missing_extra"](spark, str(tmp_path)).collect())) == want


def test_evidence_texts_end_in_the_blank_line_before_a_page(spark):
    for size in range(6, 12):
        pages = spark.createDataFrame([(1, 0, 1, "a" * size), (1, 0, 2, "b" * 9)], "s int, block int, page int, text string")
        got = {r["text"] for r in markdown.evidence_texts(pages, ["s"], "block", "page", 10).collect()}
        assert got == {("a" * size + "\n\n" + "b" * 9)[:10]}


def test_curation_sends_no_growing_table_whole(spark):
    plan = QUERIES["curated_people"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_linked_works_sends_no_growing_table_whole(spark):
    plan = QUERIES["linked_works"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_pairs_sharing_words_compare_a_text_once(spark, monkeypatch):
    rows = [(k, g, t) for k, (g, t) in enumerate([(g, t) for g in ("x", "y", None) for t in ("Ñu  gris", "ÑU GRIS", "gris", None, "", "rojo", "gris", "a b a gris")])]
    stages = []
    monkeypatch.setattr(assign, "stored", lambda df, name: stages.append(df) or df)
    got = assign.pairs_sharing_words(spark.createDataFrame(rows, "k int, g string, t string"), "g", "k", "t").collect()
    sets = {k: (g, set((t or "").upper().replace("Ñ", "N").split())) for k, g, t in rows}
    want = {(a, b, len(x & y) / len(x | y), len(x & y) / max(len(x), len(y))) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and g and x & y}
    assert sorted(map(tuple, got)) == sorted(want)
    assert [df.count() for df in stages] == [21]  # texts of a group, not rows
