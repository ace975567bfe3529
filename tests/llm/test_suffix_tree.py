"""Suffix-tree scores against dictionaries over all texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evidencespark.llm import suffix_tree
from evidencespark.llm.common import table

LEAST, GAIN = suffix_tree.LEAST, suffix_tree.GAIN


def slow(rows):
    """Results in the order of rows (doc_id, text)."""
    texts = []
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        texts.append((doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]))
    c = Counter(w for held, words in texts if not held for w in words)
    total, after = sum(c.values()), defaultdict(Counter)
    for held, words in texts:
        if not held:
            for i, w in enumerate(words):
                for k in (1, 2):
                    if i >= k:
                        after[tuple(words[i - k : i])][w] += 1
    base = lambda w: (c[w] + 0.1) / (total + 0.1 * (len(c) + 1))
    states = {}

    def probability(context, word):
        while context and context not in states:
            context = context[1:]
        if not context:
            return base(word)
        n, d = states[context]
        return (after[context][word] + d * probability(context[1:], word)) / (n + d)

    for k in (1, 2):
        found = {}
        for context, nexts in list(after.items()):
            if len(context) != k:
                continue
            seen = c[context[0]] if k == 1 else after[context[:1]][context[1]]
            if seen < LEAST or (k == 2 and c[context[0]] < LEAST):
                continue
            n, d, again = sum(nexts.values()), len(nexts), sum(x for x in nexts.values() if x > 1)
            gain = sum(round(x * (math.log(x - 1) * 256 + round(-math.log(probability(context[1:], w)) * 256))) for w, x in nexts.items() if x > 1) / 256
            gain += -again * math.log(n + d) + (n - again) * math.log(d / (n + d))
            if n >= LEAST and gain >= GAIN:
                found[context] = (n, d)
        states |= found
    out = []
    for (doc_id, _), (held, words) in zip(rows, texts):
        score = sum(math.log10(probability(tuple(words[max(0, i - 2) : i]), w)) for i, w in enumerate(words))
        out.append((doc_id, held, len(words), sum(c[w] > 0 for w in words), total, sum(math.log10(base(w)) for w in words), score))
    return out, states


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("block", "bucket"), [(suffix_tree.BLOCK, suffix_tree.BUCKET), (700, 9000)])
def test_on_documents(spark, sf, block, bucket):
    """Whole, and with texts cut into pieces over many blocks and buckets."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    want, states = slow([tuple(r) for r in docs.collect()])
    assert {len(s) for s in states} == {1, 2}
    same(suffix_tree.score_texts(docs, block, bucket).collect(), want)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    got = suffix_tree.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > 0.93 * got[0]


def test_edges(spark, edge, none):
    want, _ = slow([(r["doc_id"], r["text"]) for r in edge.collect()])
    same(suffix_tree.score_texts(edge).collect(), want)
    same(suffix_tree.score_texts(edge, 2000, 500).collect(), want)
    assert suffix_tree.score_texts(none).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = suffix_tree.score_texts(spark.createDataFrame([(alone, "no training text")], "doc_id long, text string")).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == row["score"] == 0.0
