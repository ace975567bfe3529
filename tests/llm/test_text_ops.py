"""Quality, sharding, mixing, PII, tokens and packing against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidencespark.llm import encoding, mixing, packing, pii, quality, queries, sharding, token_store
from evidencespark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_ignores_held_out_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - labels.quality).otherwise(labels.quality))
    assert quality.score_documents(docs, labels).collect() == quality.score_documents(docs, turned).collect()


def test_quality_is_the_difference_of_gaussian_log_densities(spark):
    """The fitted model against means, covariances, determinants and inverses computed in one go."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, quality.D)) @ rng.normal(size=(quality.D, quality.D)), rng.integers(0, 2, 400)
    x[y == 1] += 0.3
    model = quality.fit(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "stats array<double>, quality int").repartition(5))
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    density = []
    for c in (0, 1):
        own = z[y == c]
        a = max(quality.SHRINKAGE, quality.D / (len(own) + quality.D))
        cov = (1 - a) * np.cov(own.T, bias=True) + a * np.eye(quality.D)
        gap = z - own.mean(axis=0)
        density.append(np.log(len(own) / len(z)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-5)


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, None), (7, 3)], "doc_id long, quality int")
    assert quality.score_documents(edge, labels).count() == edge.count()
    assert quality.score_documents(none, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(edge, labels.where("doc_id < 0")).collect()} == {0.5}
    assert set(quality.keep_good(edge, labels).columns) == set(edge.columns)


def test_sharding_limits(spark, edge, none, sf):
    rows = sharding.assign_shards(table(spark, sf, "documents"), limit=20_000).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["shard"]] += r["n_bytes"]
        assert format(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16), "032b").startswith(r["shard"])
    assert len(rows) == 200 and all(by[r["shard"]] == r["shard_bytes"] for r in rows)
    parents = defaultdict(int)
    for r in rows:
        parents[r["shard"][:-1]] += r["n_bytes"] if r["depth"] else 0
    whole = {p: sum(b for s, b in by.items() if s.startswith(p)) for p in parents}
    assert all(b > 20_000 for b in whole.values()), "only oversized buckets are split"
    for r in rows:
        assert r["shard_bytes"] <= 20_000 or r["over_limit"]
    assert sharding.assign_shards(edge, limit=10).count() == edge.count()
    assert sharding.assign_shards(none).count() == 0


def test_sharding_parts_keys_that_share_24_bits(spark):
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest(), 16), "0128b") for i in range(20_000)}
    cells = defaultdict(list)
    for i, b in bits.items():
        cells[b[:24]].append(i)
    a, b = next(c for c in cells.values() if len(c) == 2)
    rows = [(a, "x" * 250), (b, "y" * 20), (7, "z" * 400), (7, "z")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=256).collect()
    apart = next(d for d in range(25, 129) if bits[a][:d] != bits[b][:d])
    want = [(a, 250, bits[a][:apart], apart, 250, False), (b, 20, bits[b][:apart], apart, 20, False), (7, 400, bits[7][:24], 24, 401, True), (7, 1, bits[7][:24], 24, 401, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        targets = [rng.choice([0, rng.random() * 100]) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 300)
        quotients = sorted((-t / (2 * k + 1), i) for i, t in enumerate(targets) if t > 0 for k in range(seats))[:seats]
        won = [sum(j == i for _, j in quotients) for i in range(len(targets))]
        assert mixing.sainte_lague(targets, seats) == won


def test_mixing(spark, sf, edge, none):
    for d in (sf, "/root/testdata/sf0.01"):
        docs = table(spark, d, "documents")
        rows = mixing.mix_documents(docs).collect()
        known = texts(spark, d)
        taken, size, target = defaultdict(int), defaultdict(int), {}
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        for r in rows:
            assert r["size"] == len(WORD.findall(known[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
            s = source[r["doc_id"]]
            taken[s] += r["taken"]
            size[s] += r["size"]
            target[s] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 64 for s in target)
        assert abs(sum(target.values()) - sum(size.values())) < 1e-3
        assert sorted(rows) == sorted(mixing.mix_documents(docs.repartition(3)).collect())
    got = mixing.mix_documents(edge).collect()
    assert len(got) == edge.count() and mixing.mix_documents(none).count() == 0


def test_small_sources_are_near_their_targets(spark):
    """Sources of 1 to 50 words beside one of 20,000: each within a 32nd, or a word, of its target, also those below their cap."""
    sizes = {f"s{n:02}": n for n in (*range(1, 20), 33, 50)} | {"big": 20_000}
    docs = [(i, s, " ".join(["w"] * (n // 2))) for i, (s, n) in enumerate(sizes.items())] + [(None if n % 2 else 100 + i, s, "w " * (n - n // 2)) for i, (s, n) in enumerate(sizes.items())]
    for weights in (mixing.cycled, lambda names: {n: 100_000.0 if n == "big" else float(sizes[n]) for n in names}):
        sized = spark.createDataFrame(docs, "doc_id long, source string, text string").select("doc_id", "source", mixing.word_count().alias("size"))
        got = mixing.mix(sized, weights).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
        assert len(got) == len(sizes)
        for r in got:
            assert abs(r["sum(taken)"] - r["max(target)"]) <= max(1.0, r["max(target)"] / 32)
    assert {r["source"]: r["sum(taken)"] for r in mixing.mix(sized).groupBy("source").agg({"taken": "sum"}).collect()} | {"big": 0} == {s: 3 * n if n < 20_000 else 0 for s, n in sizes.items()}


def test_mixed_texts_have_the_words_of_the_mix(spark, sf, edge):
    docs = table(spark, sf, "documents")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"))).collect()}
    words = defaultdict(int)
    rows = mixing.mixed_texts(docs).collect()
    for r in rows:
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = defaultdict(int)
    for r in docs.collect():
        want[r["source"]] += plan[r["doc_id"]]
    assert all(abs(words[s] - want[s]) <= 64 for s in want)
    assert mixing.mixed_texts(edge).columns == edge.columns


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_base_spans(spark, sf, edge, none):
    rng = random.Random(5)
    bits = ["a@b.co", "a@b.c%d@e.f", "x@y", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (706) 555-3138", "+49 30", "é", "𝒳", ".", "-", " ", "12", "@", "@.", "\x01", "+", "000.001.2.3", "tel"]
    made = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(1500)] + ["a." * 30000, "1" * 50000, "a@" + "b." * 5000 + "c", "1 " * 30000, "(" * 1000 + "+1" + "(" * 50000]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for docs, known in ((frame, dict(enumerate(made))), (table(spark, sf, "documents"), texts(spark, sf))):
        for r in pii.find_pii(docs).collect():
            want = base_spans(known[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (known[r["doc_id"]][:200], want, r["spans"])
            assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
            assert [s for s in r["spans"].split(",") if s.split(":")[0] in BASE] == want
            assert len(r["scores"]) == len([s for s in r["spans"].split(",") if s])
    assert pii.find_pii(edge).count() == edge.count() and pii.find_pii(none).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "my ssn is 123-45-6789."), (4, "part 123-45-6789"), (5, None), (6, "to a@b.co, 10.0.0.1"), (7, "é +1 706 555 3138")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert spans[1].startswith("iban:5:32") or "iban:5:32" in spans[1]
    assert "iban" not in spans[2] and "national_id:10:21" in spans[3] and "national_id" not in spans[4]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[5] is None and out[6] == "to <EMAIL>, <IP>" and out[7] == "é <PHONE>" and out[4] == "part 123-45-6789" and out[1].startswith("IBAN <IBAN")


def test_pii_of_a_text_with_very_many_matches(spark):
    """100,000 matches in one text, and a table of one local row: both take time in proportion to the text."""
    bits = ["mail é{i}@b.co ", "x ", "call +1 706 555 {i:04d}; ", "10.0.{j}.1 "]
    text = "".join(bits[i % 4].format(i=i % 10000, j=i % 200) for i in range(133_000))
    other = "".join(bits[i % 3].format(i=i % 10000) for i in range(6_000))
    began = time.time()
    got = pii.find_pii(spark.createDataFrame([(1, text), (2, "no")], "doc_id long, text string").repartition(1)).where("doc_id = 1").first()
    want = base_spans(text)
    assert len(want) > 99_000 and got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    for t in (text, other):
        spans = sorted(([int(x) for x in w.split(":")[1:]] + [w.split(":")[0]] for w in base_spans(t)), key=lambda x: x[0])
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [t[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert pii.redact(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()["text"] == "".join(out) + t[at:]
    assert time.time() - began < 60


def test_block_codec_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n > 10:
                ids[5] = 2**32 - 1
            payload, starts = token_store.encode_blocks(ids)
            assert (token_store.decode_blocks(payload, starts) == ids).all()
            for b in range(len(starts)):
                assert (token_store.decode_blocks(payload, starts[b : b + 1]) == ids[b * 256 : b * 256 + 256]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(6)
    bits = [" ", "\n", "\t", "\x85", "\xa0", "\x1c", "\r\n", "  ", "\u2028", "\0", "a", "Bc", "the", "don't", "'S", "'s", "İ", "é", "e\u0301", "ſ", "ΑΣ", "日本", "1", "23", "_", "!", "...", "<", "<|", "|>", "<|endoftext|>", "<|startoftext|>"]
    cases = ["", None, "a", "  a b", " lead", "trail ", *("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(3000))]
    for size in (0, 200, 1 << 20):
        e = encoding.Encoder(public_tokenizers.path(name), size)
        for at in range(0, len(cases), 500):
            some = cases[at : at + 500]
            ids, starts = e.encode(pa.array(some, pa.string()), 7)
            for text, a, b in zip(some, starts, starts[1:]):
                assert ids[a:b].tolist() == [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 7], text
            assert e.words.nbytes + e.ids.nbytes <= size + 64


def test_batches_keep_rows_in_order_and_are_bounded():
    rng = random.Random(7)
    texts = [rng.choice([None, "", "x" * rng.randint(1, 300), "y" * 2000]) for _ in range(500)]
    batches = pa.table({"text": texts, "n": range(500)}).to_batches(60)
    out = list(encoding.batches_of(iter(batches), 1000))
    assert [n for b in out for n in b["n"].to_pylist()] == list(range(500)) and [t for b in out for t in b["text"].to_pylist()] == texts
    assert all(sum(len(t or "") for t in b["text"].to_pylist()[:-1]) < 1000 for b in out)


def test_tokens(spark, sf, edge, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, at = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in token_store.token_digest(table(spark, sf, "documents"), path).collect()}
    for i, text in sorted(texts(spark, sf).items()):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    rows = token_store.token_digest(edge, path).collect()
    assert len(rows) == edge.count() and sorted(r["start"] for r in rows)[0] == 0
    assert token_store.token_digest(none, path).count() == 0


def check_packing(rows, ids_of):
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    total = padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for i, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[i])
            assert r["ids_crc32"] == zlib.crc32(ids_of[i][at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[i])
    assert docs.keys() == ids_of.keys()
    return padding / total


def test_packing(spark, sf, edge, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts(spark, sf).items()}
    assert check_packing(packing.pack_documents(table(spark, sf, "documents"), path).collect(), want) < 0.02
    got = packing.pack_documents(edge, path).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in edge.collect()}
    assert packing.pack_documents(none, path).count() == 0


def test_packing_alone_takes_the_encoders_own_bounds(spark, sf, monkeypatch):
    asked, own = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *args, **more: asked.append((more["cache_bytes"], more["batch_bytes"])) or own(*args, **more))
    one = sorted(map(tuple, queries.op8_packing(spark, str(sf)).collect()))
    assert asked == [(encoding.CACHE_BYTES, encoding.BATCH_BYTES)]
    assert one == sorted(map(tuple, packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")).collect()))
    assert asked[1] == (packing.CACHE_BYTES, packing.BATCH_BYTES)


def test_each_tier_has_windows_of_its_own_length(spark):
    rng = random.Random(2)
    for lengths in ([300] * 50, [rng.randint(1, 2047) for _ in range(700)], [int(min(2047, rng.lognormvariate(5, 1) + 1)) for _ in range(2000)], [1], [2047], []):
        windows = packing.pack_tiers(np.array(lengths, dtype=int))
        fills = [sum(b - a for _, a, b in w) for _, w in windows]
        assert all(0 < f <= t for f, (t, _) in zip(fills, windows)) and sum(f < t for f, (t, _) in zip(fills, windows)) <= 1
        pieces = sorted(p for _, w in windows for p in w)
        at = {}
        for i, a, b in pieces:
            assert a == at.get(i, 0) < b
            at[i] = b
        assert at == dict(enumerate(lengths))
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(["the"] * 299)) for i in range(64)], "doc_id long, text string")
    rows = packing.pack_documents(docs, path).collect()
    fill, tier, group = defaultdict(int), {}, defaultdict(set)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
        tier[r["sequence_id"]] = r["tier"]
        group[r["step_group"]].add(r["sequence_id"])
    assert max(tier.values()) == 512 and sum(fill.values()) == 64 * 300 and sum(fill[s] < tier[s] for s in tier) <= 1
    assert max(map(len, group.values())) <= 16 and len({sum(tier[s] == 512 for s in g) for g in group.values()}) <= 2
