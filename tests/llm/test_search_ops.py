"""SimHash, KD-tree searches, HTML extraction and the pipeline against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evidencespark.llm import ann, exact_search, html_text, simhash
from evidencespark.llm.common import table


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_components(fps):
    """fps: {doc_id: fingerprint}"""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_documents(spark, sf, edge, none):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    want = {i: slow_fingerprint(t) for i, t in docs.items()}
    groups = slow_components(want)
    for r in simhash.near_duplicates(table(spark, sf, "documents")).collect():
        assert r["fingerprint"] == format(want[r["doc_id"]], "016x") and r["component_id"] == groups[r["doc_id"]]
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 3 and 15, the middle one under a null doc_id."""
    @F.udf("long")
    def given(text):
        return int(text)

    monkeypatch.setattr(simhash, "fingerprints", given)
    docs = spark.createDataFrame([(2, "0"), (None, "3"), (1, "15"), (9, "-1"), (None, "255")], "doc_id long, text string")
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {f"{x & (1 << 64) - 1:016x}": c for x, c in ((0, 1), (3, 1), (15, 1), (-1, 9), (255, None))}


def test_links_connect_crowded_variants(spark):
    """Many fingerprints around a few centres, on a chain, and with one segment in common: more than a window under a variant."""
    rng = random.Random(3)
    fps = {0, 1, 3, 7, 15, 31, 63, 127}
    for centre in (rng.getrandbits(64), 0xFFFFFFFFFFFFFFFF):
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(32)
            fps.add(x)
        fps |= {(centre & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(80)}
    nodes = {i: f for i, f in enumerate(sorted(fps))}
    signed = {f - (1 << 64) if f >= 1 << 63 else f: i for i, f in nodes.items()}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    edges = spark.createDataFrame([tuple(sorted((signed[r["a"]], signed[r["b"]]), reverse=True)) for r in found], "a long, b long")
    got = {i: i for i in nodes} | {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == slow_components(nodes)


def test_fingerprints_of_one_segment_meet_once(spark, monkeypatch):
    """Thirty with the same upper segment, within two bits of one: none of them meet under the segment's 32 variants."""
    fps = [5 << 32 | (1 << i if i else 0) for i in range(30)]
    kept = {}
    own = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: kept.setdefault(name, own(df, name)))
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a > b and (a ^ b).bit_count() <= 2}
    places = [r["variant"] >> 32 for r in kept["simhash-counts"].collect()]
    assert 65 in places and not [p for p in places if 32 <= p < 64]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1001, 1000)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def vectors_of(spark, n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(n, None), (n + 1, [float("nan")] * d), (n + 20, [0.0] * d), (n + 21, [1.0, None]), (n + 22, [float("inf")] * d)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), v


def test_exact_search(spark):
    frame, v = vectors_of(spark)
    ints = np.floor(v.astype(float) * 256)
    ints, ids = np.vstack([ints, np.zeros(16)]), [*range(900), 920]
    for make_rows in (8192, 200):
        found = exact_search.top_k(exact_search.prepared(frame, False), 50, 5, lambda i, x: exact_search.InnerProductIndex(i, x, 5), "long", make_rows)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], int(r["score"])) for r in found.collect()}
        for q in range(0, 900, 50):
            scores = sorted((-int(s), i) for s, i in zip(ints @ ints[q], ids) if i != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in scores]
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [3e38, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in exact_search.exact_top_k(big).orderBy("rank").collect()][:1] == [1]
    huge = [(0, [1e308, -1e308, 3.0]), (1, [1e308, 1e308, 2.5]), (2, [-1e308, 0.0, 1.0]), (3, [0.0, 0.0, 7.25]), (None, [1.0, 1.0, 1.0]), (3, [0.0, 0.0, -1.0])]
    got = exact_search.exact_top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 256 * 3 * 1856), (1, 640 * 768), (3, -256 * 768), (2, -(2**63 - 1))]
    clash = frame.where("vec_id < 5").withColumn("query_id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("shard", F.lit(0)).withColumn("id", F.lit(0))
    assert exact_search.exact_top_k(clash).count() == 4 == ann.approximate_top_k(clash).count()
    assert exact_search.exact_top_k(frame.where("vec_id < 3")).count() == 2 and exact_search.exact_top_k(frame.where("vec_id < 0")).count() == 0


def test_ann_recall(spark):
    frame, v = vectors_of(spark, n=3000, d=64)
    v = v.astype(float)
    for frame, v in ((frame, v), (table(spark, "/root/testdata/sf0.01", "embeddings"), None)):
        if v is None:
            rows = {r["vec_id"]: r["embedding"] for r in frame.collect()}
            v = np.array([rows[i] for i in range(len(rows))])
        hit = total = 0
        got = {}
        for r in ann.approximate_top_k(frame).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in range(0, len(v), 20):
            s = (v * v[q]).sum(axis=1)
            s[q] = -np.inf
            best = np.lexsort((np.arange(len(v)), -s))[:20]
            mine = sorted(got[q])
            assert len(mine) == 20 and all(abs(s[i] - x) < 1e-9 for _, i, x in mine)
            hit += len({i for _, i, _ in mine} & set(best.tolist()))
            total += 20
        assert hit / total >= 0.93
    assert ann.approximate_top_k(frame.where("vec_id < 0")).count() == 0


def test_ann_edges(spark):
    """Ties, repeated and null ids, fewer candidates than k, and components whose squares leave a double's range."""
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, -0.5]), (4, [0.5, 9.0]), (5, [0.25, 0.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (8, None), (9, [1.0, None])]
    for unit in (1.0, 1e250, 1e-250):
        frame = spark.createDataFrame([(i, v and [x and x * unit for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        got = ann.approximate_top_k(frame).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 3), (0, 2, 4), (0, 3, 5), (0, 4, 5)]
        if unit == 1.0:
            assert [r["score"] for r in got] == [0.5, 0.5, 0.5, 0.25]


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 2) - 5.991465) < 1e-5 and abs(ann.chi_square_quantile(0.9, 12) - 18.549) < 1e-2


PAGE = """<html><head><title>No</title><script>var t="</p>";</script></head><body><header><h1>Site name</h1></header>
<div class="cookie-notice">We use cookies. Please accept them all now, thanks.</div>
<div id="sidebar"><p>A long sidebar paragraph that has many words, and commas, and ends in a stop. It goes on.</p></div>
<article><h1>Title</h1><p><b>First paragraph&amp; of the   article, with enough words<br>to be a paragraph, really.<p>Second &lt;b&gt; one &eacute; &#8212; it is.</p>
<div class="comments"><p>I think this article is very wrong, and here are my reasons for that: none at all really.</p></div></article>
<form><p>Subscribe to us by mail, and you will get more of this every single day.</p></form><footer>c 2020</footer></bo"""


def test_html_main_text(spark, sf):
    want = "Title\nFirst paragraph& of the article, with enough words to be a paragraph, really.\nSecond <b> one é — it is."
    assert html_text.TreeModel({}).extract(PAGE) == want
    model = html_text.fit(table(spark, sf, "pages"))
    assert model.extract(PAGE) == want
    assert model.extract(None) == "" and model.extract("") == "" and model.extract("<") is not None


def test_training_on_labelled_pages_changes_the_text_of_others(spark):
    """On labelled pages short list items are content and long sentences in plain divisions are not; a page without main or article, of
    the same make, is read as the labelled ones are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = lambda n: " ".join(word() for _ in range(n))
    page = lambda tag: f"<body><div><div>{line(30)}.</div><div>{line(30)}.</div></div><{tag}><ul>" + "".join(f"<li>{line(2)}</li>" for _ in range(9)) + f"</ul></{tag}></body>"
    pages = spark.createDataFrame([(i, "u", page("article")) for i in range(40)] + [(100 + i, "u", page("section")) for i in range(10)], "page_id long, url string, html string")
    model = html_text.fit(pages)
    plain = html_text.TreeModel({})
    right = {True: 0, False: 0}
    for r in pages.where("page_id >= 100").collect():
        want = [x for x in __import__("re").findall("<li>(.*?)</li>", r["html"])]
        for m in (model, plain):
            right[m is model] += m.extract(r["html"]).split("\n") == want
    assert right == {True: 10, False: 0}


def test_html_pages_give_their_articles(spark, sf):
    import html
    import re

    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
        want = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<div>" * 3000 + "x"), (3, "u", "plain < text & more")], "page_id long, url string, html string")
    assert html_text.extract_pages(odd).count() == 4 and html_text.extract_pages(odd.where("page_id < 0")).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    model = html_text.TreeModel({})
    page = html_text.Page("<div class=ad>one<p>two words, here.</p></div><p>three <a>x</a></p>")
    n, weights = len(page.parent), {}
    for labels in itertools.product((0, 1), repeat=n):
        w = model.pair["pair:root"][labels[0]]
        for i, f in enumerate(page.features):
            w *= np.exp(sum(model.unary[x][labels[i]] for x in f))
            if i:
                w *= model.pair[f"{page.pair_kind(i)}:{labels[page.parent[i]]}"][labels[i]]
        weights[labels] = w
    whole = sum(weights.values())
    for i, m in enumerate(model.marginals(page)):
        assert abs(m - sum(w for labels, w in weights.items() if labels[i]) / whole) < 1e-9


def test_pipeline(spark, sf, edge, none):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf)
        assert seen.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    for frame in (edge, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf).count() >= 0
