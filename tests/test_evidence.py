"""Queries against their SQL, and operators on small literal cases."""

import datetime as dt
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]
import oracle  # noqa: E402

from evidencespark.functions import dates, fuzzy, records, similarity, text  # noqa: E402
from evidencespark.operators import anchors, chains, curate, fragments, intervals, pages, quality  # noqa: E402
from evidencespark.plans import base, queries, report_queries  # noqa: E402, F401
from evidencespark.plans.registry import ORACLES, QUERIES  # noqa: E402
from evidencespark.sources import readers  # noqa: E402
from evidencespark.streaming import progress  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.difference(spark, QUERIES[name], ORACLES[name], SF) == ""


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_examples(spark):
    assert one(spark, text.normalize_text, "Supervisión de la Obra del Hospital") == "supervision obra hospital"
    assert one(spark, text.normalize_role, "Jefe y/o Gerente y/o Director") == "jefe"
    assert one(spark, text.normalize_role, "Especialista en la especialidad de Estructuras") == "especialista en estructuras"
    assert one(spark, text.gender_neutral, "Ingeniero Civil") == one(spark, text.gender_neutral, "Ingeniera Civil")
    assert len(one(spark, text.split_titles, "Ingeniero Eléctricc y/0 Ingeniero Electronico")) == 2
    assert one(spark, dates.parse_months, "Experiencia mínima de (24) meses") == 24
    assert one(spark, records.clean_duration, "48 meses (contabilizada desde la emisión del grado o título)") == "48 meses"


def test_dates(spark):
    for written, day in (("10 de enero del 2023", dt.date(2023, 1, 10)), ("01/ENE/2018", dt.date(2018, 1, 1)), ("15.03.2020", dt.date(2020, 3, 15)), ("2023-01-15", dt.date(2023, 1, 15)), ("a la fecha", None), ("31/02/2020", None), (None, None)):
        assert one(spark, dates.parse_spanish_date, written) == day
    period = one(spark, dates.split_period, "22.05.2017 al 31.12.2019")
    assert (period["start"], period["end"]) == (dt.date(2017, 5, 22), dt.date(2019, 12, 31))


def test_three_valued_match(spark):
    rows = [("hospital regional", "salud"), ("obra varia", "hospital"), ("colegio nacional", "hospital"), (None, "hospital"), ("x", None)]
    df = spark.createDataFrame(rows, "v string, w string").select(similarity.match_sector(F.col("v"), F.col("w")).alias("m"))
    assert [r["m"] for r in df.collect()] == [True, None, False, None, True]


def test_interval_union_equals_day_sets(spark):
    rng, rows = random.Random(4), []
    for k in range(40):
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 60)
            rows.append((k, dt.date(2020, 1, 1) + dt.timedelta(a), dt.date(2020, 1, 1) + dt.timedelta(a + rng.randint(0, 20))))
    merged = intervals.merge_intervals(spark.createDataFrame(rows, "k int, start date, end date"), ["k"]).collect()
    days = lambda rs: {(k, a + dt.timedelta(i)) for k, a, b in rs for i in range((b - a).days + 1)}
    assert days([(r["k"], r["start"], r["end"]) for r in merged]) == days(rows)
    assert sum((r["end"] - r["start"]).days + 1 for r in merged) == len(days(rows))


def test_effective_days_illustration(spark):
    own = spark.createDataFrame([("p", 1, dt.date(2019, 1, 1), dt.date(2019, 4, 28), None)], "person string, experience int, start date, end date, issued date")
    stop = spark.createDataFrame([(dt.date(2019, 2, 1), dt.date(2019, 3, 2))], "start date, end date")
    assert intervals.effective_days(own, stop, "person", "experience").first()["days"] == 87


def test_effective_days_by_expression_and_by_join(spark, monkeypatch):
    rng = random.Random(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    own = [(i % 3, i, day(a), None if i % 9 == 0 else day(a + rng.randint(-2, 90)), day(a + 60)) for i in range(60) for a in [rng.randint(0, 200)]]
    stops = [(day(a), day(a + rng.randint(0, 40))) for a in rng.sample(range(250), 9)]
    e, x = spark.createDataFrame(own, "p int, e int, start date, end date, issued date"), spark.createDataFrame(stops, "start date, end date")
    got = sorted(map(tuple, intervals.effective_days(e, x, "p", "e").collect()))
    monkeypatch.setattr(intervals, "MAX_WINDOWS", 0)
    assert got == sorted(map(tuple, intervals.effective_days(e, x, "p", "e").collect()))
    closed = {day(n) for a, b in stops for n in range((a - day(0)).days, (b - day(0)).days + 1)}
    want = {i: ((end - a).days, sum(a <= d <= end for d in closed)) for _, i, a, b, c in own for end in [b or c] if end >= a}
    assert {r[1]: (r[2], r[3]) for r in got} == want and all(r[4] == max(0, r[2] - r[3]) for r in got)
    assert intervals.effective_days(e, x.where("start is null"), "p", "e").agg({"excluded_days": "sum"}).first()[0] == 0


def test_page_dumps(spark):
    dump = "## Página 1  _paddle · conf 0.931_\n\n```\nhola\n```\n--- Página 2 ---\nsin cerca\n## Pagina 3  _x_\n```\nfin\n```\n"
    rows = readers.read_page_results(spark.createDataFrame([("d", dump)], "doc_id string, dump string")).orderBy("page_num").collect()
    assert [(r["page_num"], r["confidence"], r["text"]) for r in rows] == [(1, 0.931, "hola"), (2, None, "sin cerca"), (3, None, "fin")]


def test_model_json(spark):
    rows = [('```json\n{"a": 1}\n```',), ('so: {"a": [1, 2,',), ("no answer",)]
    got = records.parse_model_json(spark.createDataFrame(rows, "raw string"), "raw").select("outcome").collect()
    assert [r["outcome"] for r in got] == ["parsed", "repaired", "failed"]


def folded(sizes, most, overlap=1):
    """Parts, as lists of places, of one document."""
    if sum(sizes) <= most:
        return [list(range(len(sizes)))] if sizes else []
    out, i = [], 0
    while i < len(sizes):
        part, chars = [], 0
        while i < len(sizes) and (not part or chars + sizes[i] <= most):
            part.append(i)
            chars += sizes[i]
            i += 1
        out.append(part)
        if len(part) > overlap:
            i -= overlap
    return out


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_pack_pages_equals_a_fold(spark, monkeypatch, overlap):
    """Long and blank pages, gaps in page numbers, stretches of few pages, a null document, one that fits, one marked whole, table pages."""
    monkeypatch.setattr(pages, "running_sums", lambda *a: chains.running_sums(*a, stretch=7))
    rng, rows, want = random.Random(9), [], []
    for doc in ("a", "b", None, "fits", "whole"):
        numbers = sorted(rng.sample(range(1, 300), 4 if doc == "fits" else 90))
        sizes = [rng.choice((0, 0, 5, 40, 90, 300)) for _ in numbers] if doc != "fits" else [10] * 4
        tables = [rng.random() < 0.1 and doc != "whole" for _ in numbers]
        rows += [(doc, p, "x" * n, t) for p, n, t in zip(numbers, sizes, tables)]
        plain = [k for k, t in enumerate(tables) if not t]
        parts = [plain] if doc == "whole" else [[plain[k] for k in part] for part in folded([sizes[k] for k in plain], 200, overlap)]
        parts = sorted([*parts, *([k] for k, t in enumerate(tables) if t)], key=lambda part: part[0])
        want += [(doc, n, numbers[k]) for n, part in enumerate(parts, 1) for k in part]
    df = spark.createDataFrame(rows, "doc string, page int, text string, is_table boolean")
    got = pages.pack_pages(df, "doc", "page", 200, overlap, F.col("is_table"), F.col("doc") == "whole").collect()
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert pages.pack_pages(df.where("page < 0"), "doc", "page").count() == 0


def test_section_texts_with_texts_inside_or_apart(spark):
    """A missing page, a range of the separator alone, one without pages, and a section left without any."""
    pages_ = spark.createDataFrame([("d", 1, 10, "a"), ("d", 2, 20, "b"), ("d", 4, 40, None), ("e", 1, 50, "x")], "doc string, page int, id int, text string")
    kind = "doc string, section int, separator int, ranges array<struct<first int, last int>>"
    sections = spark.createDataFrame([("d", 1, 1, [(1, 3), (1, 1), (30, 40), (4, 4)]), ("e", 1, 1, [(1, 1)]), ("e", 2, None, [(1, 1)])], kind)
    want = {("d", 1): ["[Página 2]\nb", "", "[Página 4]\n"], ("e", 2): ["[Página 1]\nx"]}
    for how in ({}, {"texts": pages_.select("id", "text"), "page_id": "id"}):
        got = pages.attach_pages_to_sections(sections, pages_, "doc", "page", "section", **how).collect()
        assert {(r["doc"], r["section"]): r["texts"] for r in got} == want and {r["text"] for r in got} == {"\n\n".join(t) for t in want.values()}


def test_overlap_join_equals_all_pairs(spark):
    """Short, long, reversed and open intervals; each pair once, whatever the bins."""
    rng = random.Random(2)
    day = lambda n: dt.date(1969, 12, 1) + dt.timedelta(n)
    make = lambda k: [(i, rng.randint(0, 2), a, a and day((a - day(0)).days + rng.choice((-3, 0, 1, 9, 200)))) for i in range(k) for a in [rng.choice((None, day(rng.randint(0, 90))))]]
    left, right = make(60), make(60)
    want = sorted((i, j) for i, k, s, e in left for j, q, t, f in right if k == q and s and t and s <= f and t <= e)
    for days in (1, 7, 32):
        got = intervals.overlap_join(spark.createDataFrame(left, "i int, k int, s date, e date"), spark.createDataFrame(right, "j int, k int, t date, f date"), ["k"], ("s", "e"), ("t", "f"), days)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_fuzzy_is_one_to_one(spark):
    left = spark.createDataFrame([("g", "alpha beta"), ("g", "gamma delta"), ("g", "alpha beto")], "g string, a string")
    right = spark.createDataFrame([("g", "beta alpha"), ("g", "gamma delte")], "g string, b string")
    got = quality.fuzzy_one_to_one(left, right, "g", "a", "b", 0.85).collect()
    assert len({r["a"] for r in got}) == len({r["b"] for r in got}) == len(got) == 2


def greedy(pairs):
    """Of (group, a, b, ratio), from the most similar down, ties by value, each value once."""
    used, out = set(), []
    for group, a, b, ratio in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if (group, a, 0) not in used and (group, b, 1) not in used:
            used |= {(group, a, 0), (group, b, 1)}
            out.append((group, a, b, ratio))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_fuzzy_pairs_equal_a_greedy_choice_among_all(spark, threshold):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    make = lambda: [(rng.choice((None, "g", "h")), " ".join(word() for _ in range(rng.randint(0, 4)))) for _ in range(120)]
    left, right = make(), make()
    plain = lambda t: " ".join(sorted(t.replace("é", "e").lower().split()))
    ratio = lambda a, b: round(2 * plain_lcs(a, b) / (len(a) + len(b)), 6) if a or b else 1.0
    pairs = [(g, a, b, ratio(plain(a), plain(b))) for g, a in set(left) for h, b in set(right) if g == h]
    got = quality.fuzzy_one_to_one(spark.createDataFrame(left, "g string, a string"), spark.createDataFrame(right, "g string, b string"), "g", "a", "b", threshold)
    assert sorted(map(tuple, got.collect()), key=str) == greedy([p for p in pairs if p[3] >= threshold])


def test_golden_rows_choose_in_order(spark):
    """Numbers that are null, repeated and taken, names that hold each other, blank names: one found row for each golden row, as choosing one
    after the other gives."""
    rng = random.Random(11)
    names = ("", "Jefe", "jefe de obra", "JEFE  DE OBRA Principal", "Obra", "Residente", "a", "Géologo")
    make = lambda: [(rng.choice((None, 1, 2)), rng.choice((None, 1, 2, 3, 4)), rng.choice(names)) for _ in range(60)]
    found, golden = make(), make()
    plain = lambda t: " ".join(t.lower().replace("é", "e").split())
    order = lambda r: (r[1] is None, r[1] or 0, r[2])
    want = []
    for doc in (None, 1, 2):
        left, mine = sorted((f for f in found if f[0] == doc), key=order), sorted((g for g in golden if g[0] == doc), key=order)
        for g in mine:
            a = plain(g[2])
            fits = lambda f: a == plain(f[2]) or a != "" and a in plain(f[2]) or plain(f[2]) != "" and plain(f[2]) in a  # noqa: B023, E731
            hit = next((f for f in left if g[1] is not None and f[1] == g[1]), None) or next((f for f in left if fits(f)), None)
            if hit:
                left.remove(hit)
            want.append((doc, g[2], hit and hit[2], "matched" if hit else "missing"))
        want += [(doc, None, f[2], "hallucinated") for f in left]
    got = quality.match_golden(spark.createDataFrame(found, "d int, n int, x string"), spark.createDataFrame(golden, "d int, n int, x string"), "d", "n", "x")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    lost = quality.match_golden(spark.createDataFrame([("d", 1, "A")], "d string, n int, x string"), spark.createDataFrame([("d", 1, "A"), ("d", 2, "A")], "d string, n int, x string"), "d", "n", "x")
    assert sorted(r["status"] for r in lost.collect()) == ["matched", "missing"]


def test_micro_metrics_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, 2), (2, 0, 3, 0), (3, 0, 0, 0), (4, 1, 1, 0)], "d int, tp long, fp long, fn long")
    got = {r["d"]: (r["precision"], r["recall"], r["f1"]) for r in quality.micro_metrics(df, ["d"]).collect()}
    assert got == {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (1.0, 1.0, 1.0), 4: (0.5, 1.0, 0.667)}


def test_row_anchors_equal_all_pairs(spark):
    """Roles bent by a letter or two, run together, cut, backwards, and short ones of short words."""
    rng = random.Random(12)
    roles = ("GERENTE DE CONTRATO", "JEFE DE OBRA", "JEFE DE OBRAS", "ESPECIALISTA EN COSTOS", "ESPECIALISTA EN COSTOS Y PRESUPUESTOS", "A B DE LA CD", "INGENIERO RESIDENTE")
    lines = ["GERENTEDE CONTRATO", "jefes  de obras", "jefé de obra", "obra", "DE LA A B CD EF", "A B C DE LA", None, "", "x" * 300, "INGENIERO CIVIL y/o ARQUITECTO"]
    for role in roles * 12:
        bent = list(role)
        for _ in range(rng.randint(0, 3)):
            bent[rng.randrange(len(bent))] = rng.choice(("", "X", " ", "E"))
        lines.append("".join(bent) + rng.choice(("", " N 3", " de la obra")))
    norm = lambda t: " ".join((t or "").upper().replace("É", "E").split())
    want = []
    for line in lines:
        scores = [(round(fuzzy.token_set(r, norm(line)), 9), len(r), -i) for i, r in enumerate(roles)] if 8 <= len(norm(line)) <= 200 else []
        best = max(scores, default=(0, 0, 0))
        want.append(roles[-best[2]] if best[0] >= 92 else None)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = anchors.row_anchors(df, anchors.catalogue(spark, roles), "t").orderBy("i").collect()
    assert [r["anchor"] for r in got] == want and None in want and len(set(want)) > 5


def test_inferred_numbers_equal_a_search(spark):
    import re

    rng = random.Random(13)
    words = ("JEFE", "jefe", "obra", "Obras", "señal", "de")
    text = lambda: "".join(rng.choice((*words, "1", "27", "31", "405", " ", "  | ", "\n", ". ", " " * 31)) for _ in range(40))
    texts = [(d, text()) for d in (None, *range(30))] + [(30, None)]
    rows = [(d, role) for d, _ in texts for role in ("Jefe de Obra", "Señal", "Obras y Señal", "de", None)]
    want = {}
    for d, role in rows:
        whole, found = dict(texts)[d] or "", None
        for w in re.findall(r"\b[A-ZÁÉÍÓÚÑ]{4,}\b", (role or "").upper())[-2:]:
            hits = [int(m[1] or m[2]) for m in re.finditer(rf"(\d{{1,2}})[\s|]{{0,30}}{w}|{w}[\s|]{{0,30}}(\d{{1,2}})", whole, re.I)]
            found = found or next((n for n in hits if 1 <= n <= 30), None)
        want[d, role] = found
    got = anchors.infer_row_numbers(spark.createDataFrame(rows, "d int, r string"), spark.createDataFrame(texts, "d int, t string"), "d", "r", "t").collect()
    wrong = {(r["d"], r["r"]): (r["inferred"], want[r["d"], r["r"]]) for r in got if r["inferred"] != want[r["d"], r["r"]]}
    assert len(got) == len(rows) and not wrong and len(set(want.values())) > 3


def test_curation_of_any_keys_and_inferred_numbers(spark):
    """Document names that are texts or null; a row without a number is laid over and ordered by the number next to its role."""
    none = "array<string>"
    titles = spark.createDataFrame([("a:1", 2, "Jefe", ["Civil"], 1), ("a:1", None, "Residente", [], 1), (None, 1, "Gestor", ["x"], 1)], f"doc string, number long, role string, titles {none}, page int")
    experience = spark.createDataFrame([("a:1", 2, 12, ["Jefe"], "w", 2)], f"doc string, number long, months int, roles {none}, work string, page int")
    visual = spark.createDataFrame([("a:1", 1, ["Arquitecto"], [], 24, "v")], f"doc string, number long, titles {none}, roles {none}, months int, work string")
    training = spark.createDataFrame([("a:1", 2, 40), (None, 1, 8), ("b", 3, 5)], "doc string, number long, hours long")
    texts = spark.createDataFrame([("a:1", "| 1 | RESIDENTE | 2 | JEFE")], "doc string, text string")
    got = curate.curate_requirements(titles, experience, visual, training, texts=texts).collect()
    rows = {(r["doc"], r["role"]): (r["number"], r["row"], r["months"], r["hours"], r["titles"]) for r in got}
    assert rows["a:1", "Residente"] == (None, 1, 24, None, ["Arquitecto"]) and rows["a:1", "Jefe"] == (2, 2, 12, 40, ["Civil"])
    assert rows[None, "Gestor"][3] == 8 and len(got) <= 4


def test_pages_without_an_id_are_numbered(spark, tmp_path):
    rows = [(1, "a", "s"), (None, "b", "s"), (9000, "c", "s"), (2, "d", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["source"], r["text"]): r["page_num"] for r in base.pages(spark, str(tmp_path)).collect()}
    assert got == {("s", "a"): 1, ("s", "c"): 2, ("s", "b"): 3, (None, "d"): 1}


def test_changes_as_a_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, i), s) for i, s in enumerate(["run", "run", "page", "done"])]
    spark.createDataFrame(rows, "job int, ts timestamp, state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job int, ts timestamp, state string").parquet(str(tmp_path / "in"))
    q = progress.emit_changes_stream(stream, "job", "ts", "state").writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["state"] for r in spark.table("changes").orderBy("ts").collect()] == ["run", "page", "done"]


def test_unsupported_values(spark):
    rows = [(["Jefe de Obra", "Mitigacion Ambiental", "Electromecanicco Residente", "ab", None], "Jefe de  obra y/o electromecanico residente"), (["x y z"], ""), (None, "a"), (["Electromecanicco Residente de Obra"], "electromecanico residente de obra")]
    got = fragments.drop_unsupported_values(spark.createDataFrame(rows, "v array<string>, t string"), "v", "t").collect()
    assert got[0]["v"] == ["Jefe de Obra"] and got[0]["v_rejected"] == ["Mitigacion Ambiental", "Electromecanicco Residente", "ab", None]  # the text's other words take the ratio of word sets below its limit
    assert got[1]["v"] == ["x y z"] and got[2]["v"] is None and got[3]["v_rejected"] == []


def test_factors(spark):
    rows = spark.createDataFrame([("d", "Jefe de Estudio", None), ("d", "Arquitecto", None), ("d", "Geologo", "own"), ("e", "Geologo", None)], "doc string, role string, own string")
    factors = spark.createDataFrame([("d", 1, "Jefe de Estudio", "by years", 10), ("d", 2, "Consultoria", None, 5)], "doc string, position int, factor_role string, method string, points int")
    got = {(r["doc"], r["role"]): r["own"] for r in fragments.attach_factors(rows, factors, "doc", "role", "own").collect()}
    assert got == {("d", "Jefe de Estudio"): "by years", ("d", "Arquitecto"): "Hasta 5 puntos", ("d", "Geologo"): "own", ("e", "Geologo"): None}


def test_tables_in_pages(spark):
    long = "a line of prose that is clearly longer than forty characters in all"
    page = "\n".join([long] * 6 + ["a", "b", "c", "d", "e"] + [long] * 6)
    df = spark.createDataFrame([(page, "|t|"), ("x\ny", "|t|"), ("\n".join([long] * 6), "|t|")], "x string, t string")
    got = [r[0] for r in df.select(fragments.replace_table_zone(F.col("x"), F.col("t"))).collect()]
    assert "|t|" in got[0] and "\nb\n" not in got[0] and got[0].startswith(long) and got[0].endswith(long) and got[1:] == ["|t|", "|t|"]
    parts = spark.createDataFrame([("k", 2, "|h|\n|---|\n|2|\nnote"), ("k", 1, "title\n|h|\n|---|\n|1|")], "k string, o int, x string")
    assert fragments.fuse_table_fragments(parts, ["k"], "o", "x").first()["x"] == "title\n|h|\n|---|\n|1|\n|h|\n|2|"
    chunks = spark.createDataFrame([("d", "Jefe de Obra", "one"), ("d", "Topografo", "two")], "doc string, role string, x string")
    other = spark.createDataFrame([("d", "JEFE DE OBRA", "three")], "doc string, role string, x string")
    assert {r["x"] for r in fragments.pair_chunks(chunks, other, "doc", "role", "x").collect()} == {"one\n\nthree", "two"}


def test_sections_without_headings_are_halved(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "one"), ("b", 2, "two"), ("b", 3, "end"), ("b", 4, "x"), ("c", 1, "x")]
    df = spark.createDataFrame(rows, "d string, p int, text string")
    got = sorted((r["d"], r["section"], r["p"]) for r in pages.section_page_spans(df, df.where("d <> 'b'").select("d", "p"), "d", "p", ("one", "two", "three"), "end").collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("b", 2, 3), ("c", 1, 1), ("c", 2, 1)]


def test_nested_records(spark):
    deep = '{"type": "table", "data": {"cells": [{"row": 0, "col": 1}, {"row": 1, "col": 1}]}, "in": [{"label": "x", "k": {"label": "My Table"}}]}'
    df = spark.createDataFrame([(1, deep), (2, None), (3, "{bad"), (4, "[]"), (5, '{"label": 3}')], "id int, raw string")
    got = [tuple(r) for r in records.find_nested_records(df, "raw").orderBy("path").collect()]
    assert got == [(1, "$", "table", 2, 1), (1, "$.in[0].k", "My Table", 0, 0)]
    shapes = spark.createDataFrame([([[1], [1, 2]],), ([],), (None,)], "g array<array<int>>").select(records.matrix_shape(F.col("g")).alias("s")).collect()
    assert [tuple(r["s"]) for r in shapes] == [(2, 2), (0, 0), (0, 0)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_ratios_equal_plain_ones(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé ñ\U0001f600") for _ in range(rng.randint(0, n)))
    pairs = [(word(n), word(m)) for n in (3, 20, 64, 70, 130) for m in (3, 30, 64, 90) for _ in range(30)] + [("a" * 64, "ba" * 64), ("", ""), ("a\0b", "a\0b")]
    assert fuzzy.lcs_batch(*map(list, zip(*pairs))).tolist() == [plain_lcs(a, b) for a, b in pairs] == [fuzzy.lcs(a, b) for a, b in pairs]
    for a, b in pairs[:400:7]:
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        want = max((200 * plain_lcs(short, w) / (len(short) + len(w)) for w in windows), default=0) if short else 0
        assert abs(fuzzy.partial(a, b) - want) < 1e-9
    assert fuzzy.partial("jefe de obra", "el jefe de obra principal") == 100 and fuzzy.partial("", "a") == 0 and fuzzy.partial("abc", "xyz") == 0
    df = spark.createDataFrame([(a, b) for a, b in pairs[:50]] + [(None, "x"), (None, None)], "a string, b string").select(fuzzy.indel_ratio("a", "b").alias("r"))
    want = [2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in pairs[:50]] + [0.0, 1.0]
    assert [r["r"] for r in df.collect()] == pytest.approx(want)


def test_token_sets_equal_plain_ones():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(("jefe", "de", "obra", "obras", "civil", "residente", "a")) for _ in range(rng.randint(0, n)))
    for _ in range(300):
        a, b = text(5), text(9)
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        p, q = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
        ratio = lambda s, t: 200 * plain_lcs(s, t) / (len(s) + len(t)) if s or t else 100.0
        want = max(ratio(p, q), *((ratio(both, p), ratio(both, q)) if both else (0, 0))) if x and y else 0
        assert abs(fuzzy.token_set(a, b) - want) < 1e-9


def test_near_words_equal_all_windows():
    rng = random.Random(5)
    for _ in range(400):
        word = "".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 30)))
        bent = list(word)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(bent))
            bent[i : i + 1] = rng.choice(("", "x", bent[i] + "y"))
        text = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 40))) + "".join(bent) + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 20)))
        n = len(word)
        want = word in text or n >= 7 and any(200 * plain_lcs(word, w) / (n + len(w)) >= 92 for i in range(1 - n, len(text)) for w in [text[max(0, i) : i + n]])
        assert fuzzy.near(word, text, 92.0, 7) == want


def test_a_long_page_in_seconds():
    import time

    page, began = "lorem ipsum dolores sit amet consectetur " * 25_000 + "electromecanicco residente general ", time.time()
    assert fuzzy.near("electromecanico", page, 92.0, 7) and not fuzzy.near("hidroelectromecanicas", page, 92.0, 7)
    assert fuzzy.partial("electromecanico", page) > 92 and fuzzy.token_set("electromecanicco residente", page) == 100 and time.time() - began < 10


def test_flagged_values(spark):
    rows = [("Jefe de Obra", "el JEFE DE OBRA, y"), ("Especialista en Edificaciones", "edificaciones y afines"), ("Residente Obra General", "obra del residente"), ("Residente Obra General Mayor", "obra del residente"), ("", "x"), ("Jefe", None), (None, None), ("Obra Civil", "civil obra")]
    got = fragments.flag_unsupported_values(spark.createDataFrame(rows, "v string, t string"), "v", "t").collect()
    assert [r["unsupported"] for r in got] == [False, True, False, True, False, False, False, False]
