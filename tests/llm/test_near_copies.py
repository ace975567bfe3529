"""The near-duplicate stage of the pipeline against all pairs."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def survivors(rows):
    """Row numbers that stay: of each component the smallest doc_id, nulls last."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(find(i), []).append((doc_id is None, doc_id or 0, i))
    return sorted(min(g)[2] for g in best.values())


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, line = [], " ".join(word() for _ in range(12))
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 200))] + line.split() * (rng.random() < 0.5)
        rows.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 50)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy[: len(copy) - rng.randint(0, len(copy) // 12)])
    crowd = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(crowd)
        copy[rng.randrange(60)] = word()
        rows.append(copy)
    texts = [" ".join(r) for r in rows] + ["a b", "a b c", "A  b", "same same same", None, "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_of_all_similarities_go(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == survivors(rows) and len(got) < len(rows) - 40
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where(F.lit(False)), "").count() == 0
