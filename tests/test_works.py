"""Linking of certificates whose names are misspelt."""

import datetime
import random

from pyspark.sql import functions as F

from evidencespark.operators import works


def test_misspelt_names_find_their_work(spark):
    day = datetime.date(2020, 1, 1)
    registry = [(1, "HOSPITAL APOYO POMABAMBA ANTONIO CALDAS", "MINSA", day), (2, "PUENTE LIMA NORTE", "MTC", day), (3, "PUENTE CALDAZ SUR", "MTC", day), (4, "HOSPITAL LIMA SUR", "MINSA", day)]
    certs = [
        (10, "HOSPITAL APOYO POMABAMBA ANTONIO CALDAS", "MINSA", day),
        (11, "HOSPITAL APOYO POMABAMBA ANTONIO CALDAZ", "MINSA", day),  # a word that only another work holds
        (12, "PUENTE NORTE SUR LIMA", "MTC", day),
        (13, "HOSPITAL ANTONIO CALDAZ", "MINSA", day),
        (14, "ESCUELA APOYO", "MINSA", day),
        (15, "NADA", "MINSA", day),
    ]
    kinds = "name string, entity string"
    got = works.link_works(spark.createDataFrame(certs, f"cert long, {kinds}, day date"), spark.createDataFrame(registry, f"work long, {kinds}, start date"), "cert", "work")
    assert {r["cert"]: r["work"] for r in got.collect()} == {10: 1, 11: 1, 12: 2, 13: 1, 14: 1}


def test_phrases_from_specific_to_generic(spark):
    names = ["Mejoramiento del Hospital de Apoyo de Pomabamba Antonio Caldas", "Pomabamba Antonio", "Puente", "obra de salud", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(works.phrase_keys(F.col("n"))).collect()]
    assert got == [["HOSPITAL POMABAMBA ANTONIO", "POMABAMBA ANTONIO CALDAS", "HOSPITAL APOYO POMABAMBA ANTONIO CALDAS", "HOSPITAL POMABAMBA"], ["POMABAMBA ANTONIO"], ["PUENTE"], [], []]


def test_recall_of_phrases_against_all_pairs(spark):
    """Certificates with generic words more or less, a kind dropped, words put in between: 95 in 100 get the work that is the best of all."""
    rng, day = random.Random(5), datetime.date(2020, 1, 1)
    word = lambda: "".join(rng.choice("BCDFGHLMNPRST") + rng.choice("AEIO") for _ in range(3))
    registry = [(i, f"{rng.choice(('HOSPITAL', 'COLEGIO', 'PUENTE'))} {word()} {word()} {word()}", word(), day) for i in range(200)]
    certs = []
    for i, name, entity, _ in registry:
        kind, *places = name.split()
        bent = (f"Mejoramiento de los servicios del {name}", " ".join(places), f"{kind} de {places[0]} de apoyo {places[1]}", f"{kind} {places[0]} y {word()}")[i % 4]
        certs.append((i, bent, entity, day))
    kinds = "name string, entity string"
    c, w = spark.createDataFrame(certs, f"cert long, {kinds}, day date"), spark.createDataFrame(registry, f"work long, {kinds}, start date")
    got = {r["cert"]: r["work"] for r in works.link_works_by_phrase(c, w, "cert", "work").collect()}
    tokens = lambda t: set(t.upper().split())
    score = lambda a, b: 50 * len(a[0] & b[0]) / len(a[0] | b[0]) + 20 * (a[1] == b[1])
    best = {i: max(registry, key=lambda r: (score((tokens(n), e), (tokens(r[1]), r[2])), -r[0]))[0] for i, n, e, _ in certs}
    assert sum(got.get(i) == b for i, b in best.items()) >= 0.95 * len(best)
