"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of up to DEPTH words. A context seen at least LEAST times in training is retained if its next-symbol distribution
diverges from that of its longest retained suffix: if leaving one out, its own counts raise the log-likelihood of what follows it by GAIN
or more. Distributions are smoothed by Witten-Bell interpolation with the suffix's, the root's by 0.1 for each word and for all unknown ones.
Each token is scored by the longest suffix of what precedes it that is a state. Texts, counts and states grow with the input; nothing
is capped and the tree is never in one place.

The job: texts are cut into blocks of about BLOCK words, each with its own vocabulary and codes. A block counts its words, contexts and
successors once each, and sends them, dealt by a hash of the words, to buckets that add up the counts of all blocks and answer each block
what it asked. A word or successor reaches a bucket once a block, however often the block has it, so no word makes a bucket large; a
bucket holds the entries of its words for all blocks, and their number grows with the table. Contexts' sums are dealt by the context alone.
Texts longer than a block are cut into pieces, each with the words that precede it.

Defined results: a null or blank text is its end alone; rows without a doc_id are hashed as a null (never held out); repeated rows count
and are scored each; without training rows all tokens are unknown to the root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, each_text, stored

HELD_OUT, PART = 10, 0
DEPTH, LEAST, GAIN = 2, 16, 4.0
ADD = 0.1
BLOCK = 1_000_000
BUCKET = 2_000_000
FINE = 256  # log-probabilities of the divergence test are whole 256ths, so sums don't depend on their order
MESSAGE = "block long, kind int, bucket long, data binary"


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, each at the least width, byte by byte, compressed."""
    out = [np.array([len(columns[0])], dtype="<i8").tobytes()]
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max(initial=0)) < 1 << 8 * w)
        out += [bytes([width]), np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    while at < len(raw):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n)
        columns.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    return columns


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of whole numbers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h >> np.uint64(1)


def dealt(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows that go to it), for buckets that get any."""
    if not len(columns[0]):
        return
    to = (mixed(columns) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order])) + 1
    for rows in np.split(order, edges):
        yield int(to[rows[0]]), rows


def messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["block", "kind", "bucket", "data"])


BLOCKS = f"{MESSAGE}, words binary, counts binary, uid array<long>, doc_id array<long>, held_out array<boolean>, last array<boolean>"


def make_blocks(block: int = BLOCK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, held_out, text) into blocks. data: code of each token and the piece's number of tokens and of leading words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, uid = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        vocabulary, codes, pieces = Vocabulary(), [], []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal vocabulary, codes, pieces, number, size
            flat = np.concatenate(codes)
            sizes, leads = (np.array([p[i] for p in pieces], dtype=np.int64) for i in (4, 5))
            own = np.repeat(np.array([not p[2] for p in pieces]), sizes)
            starts = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(leads):
                own[starts[i] : starts[i] + leads[i]] = False
            counts = np.bincount(flat[own], minlength=len(vocabulary))
            row = [number, 0, 0, pack(flat), b" ".join(vocabulary), pack(counts), *([p[i] for p in pieces] for i in range(4))]
            columns = [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_())))]
            columns.append(pa.array([pack(sizes, leads)], pa.binary()))
            number, size, vocabulary, codes, pieces = number + 1, 0, Vocabulary(), [], []
            return pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "data", "words", "counts", "uid", "doc_id", "held_out", "last", "sizes"])

        for batch in batches:
            for doc_id, held, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), each_text(batch["text"])):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(b"")  # the end
                for a in range(0, len(words), block):
                    lead = min(a, DEPTH)
                    own = words[a - lead : a + block]
                    codes.append(np.fromiter(map(vocabulary.__getitem__, own), dtype=np.int32, count=len(own)))
                    pieces.append((uid, doc_id, held, a + block >= len(words), len(own), lead))
                    size += len(own)
                    if size >= block:
                        yield close()
                uid += 1
        if pieces:
            yield close()

    return run


def answer_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Messages of words with their codes and counts: to each block the codes, ids and training counts of its words; kind 9: tokens and words
    in training."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, counts in zip(b["block"].to_pylist(), b["words"].to_pylist(), b["counts"].to_pylist()):
                words, counts = np.array(words.split(b" "), dtype=object), unpack(counts)[0]
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in words), dtype=np.int64, count=len(words))
                yield messages([(block, 1, to, _word_data(words[rows], rows, counts[rows])) for to, rows in dealt([hashes], buckets)])

    return ask


def _word_data(words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
    packed = pack(codes, counts)
    return len(packed).to_bytes(4, "little") + packed + zstandard.compress(b" ".join(words), 1)


def by_bucket(batches: Iterator[pa.RecordBatch], whole: Callable[[int, list[tuple[int, int, bytes]]], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by bucket, a bucket at a time."""
    now, held = None, []
    for b in batches:
        for block, kind, bucket, data in zip(*(b[c].to_pylist() for c in ("block", "kind", "bucket", "data"))):
            if bucket != now:
                if held:
                    yield messages(list(whole(now, held)))
                now, held = bucket, []
            held.append((block, kind, data))
    if held:
        yield messages(list(whole(now, held)))


def sum_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(bucket: int, held: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        vocabulary, parts = Vocabulary(), []
        for block, _, data in held:
            size = int.from_bytes(data[:4], "little")
            words = zstandard.decompress(data[4 + size :]).split(b" ")
            parts.append((block, np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)), *unpack(data[4 : 4 + size])))
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for _, places, _, counts in parts:
            total[places] += counts  # a block has a word once
        for block, places, codes, _ in parts:
            yield block, 1, bucket, pack(codes, places * buckets + bucket, total[places])
        yield -1, 9, bucket, pack(np.array([total.sum()]), np.array([(total > 0).sum()]))

    return lambda batches: by_bucket(batches, whole)


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where each group starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.flatnonzero(new)


def sum_successors(k: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Messages of (context of k words, next word, training count, -256 log of its probability at the suffix): to each block the totals;
    kind 8, dealt by context: its sums. A successor met once counts against the context, one met again for it."""

    def whole(bucket: int, held: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        parts = [unpack(data) for _, _, data in held]
        columns = joined(parts)
        order, starts = grouped(columns[: k + 1])
        total = np.add.reduceat(columns[k + 1][order], starts)
        each = np.empty(len(order), dtype=np.int64)
        each[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
        at = 0
        for (block, _, _), part in zip(held, parts):
            yield block, 2 * k, bucket, pack(each[at : at + len(part[0])])
            at += len(part[0])
        first = order[starts]
        seen = total > 0
        first, total = first[seen], total[seen]
        again = total > 1
        gain = np.where(again, np.round(total * (np.log(np.maximum(total - 1, 1)) * FINE + columns[k + 2][first])), 0).astype(np.int64)
        context = [c[first] for c in columns[:k]]
        order, starts = grouped(context)
        if len(order):
            sums = [np.add.reduceat(x[order], starts) for x in (total, np.ones_like(total), np.where(again, total, 0), gain)]
            names = [c[order][starts] for c in context]
            # gain may be below zero only where a successor is rarer than its suffix says: an offset keeps the packed numbers whole
            sign = [np.maximum(sums[3], 0), np.maximum(-sums[3], 0)]
            for to, rows in dealt(names, buckets):
                yield -1, 8, to, pack(*(c[rows] for c in [*names, *sums[:3], *sign]))

    return lambda batches: by_bucket(batches, whole)


def sum_contexts(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kind 8 messages and blocks' contexts (kind 7): to each block what follows each context in training and how many words it is, 0 if
    the context is not retained."""

    def whole(bucket: int, held: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        sums = [unpack(data) for _, kind, data in held if kind == 8]
        asked = [(block, unpack(data)) for block, kind, data in held if kind == 7]
        if not asked:
            return
        columns = joined([*sums, *([*part, *([np.zeros(len(part[0]), dtype=np.int64)] * 5)] for _, part in asked)])
        order, starts = grouped(columns[:k])
        n, distinct, again, more, less = (np.add.reduceat(c[order], starts).astype(float) for c in columns[k:])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (more - less) / FINE - again * np.log(n + distinct) + (n - again) * np.log(distinct / (n + distinct))
        kept = (n >= LEAST) & (gain >= GAIN)
        each = np.empty((2, len(order)), dtype=np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        for i, x in enumerate((n, distinct)):
            each[i, order] = np.repeat(np.where(kept, x, 0).astype(np.int64), sizes)
        at = sum(len(x[0]) for x in sums)
        for block, part in asked:
            yield block, 2 * k + 1, bucket, pack(*each[:, at : at + len(part[0])])
            at += len(part[0])

    return lambda batches: by_bucket(batches, whole)


class Block:
    """A block with the answers it has so far: for each order, the successors it has and the probability of each token."""

    def __init__(self, data: bytes, sizes: bytes, answers: dict[int, dict[int, bytes]], buckets: int, tokens: int, distinct: int, answered: int):
        self.codes = unpack(data)[0]
        self.sizes, self.leads = unpack(sizes)
        n = len(self.codes)
        starts = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.place = np.arange(n) - starts  # in the piece
        self.own = self.place >= np.repeat(self.leads, self.sizes)
        size = int(self.codes.max()) + 1
        self.ids, self.counts = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for data in answers[1].values():
            codes, ids, counts = unpack(data)
            self.ids[codes], self.counts[codes] = ids, counts
        self.known = self.counts[self.codes] > 0
        self.base = (self.counts + ADD) / (tokens + ADD * (distinct + 1))
        self.probability = self.base[self.codes]
        self.asked: list[tuple] = []
        frequent = self.counts[self.codes] >= LEAST  # the context that ends at each token
        name = self.codes  # of that context: its number among the block's
        names = [self.ids]
        for k in range(1, DEPTH + 1):
            at = np.flatnonzero(self.place >= k)  # with leading words, whose successors are contexts; they are counted in the piece before
            at = at[frequent[at - 1]]
            pairs, first, inverse = np.unique(name[at - 1] * size + self.codes[at], return_index=True, return_inverse=True)
            context, following = pairs // size, pairs % size
            columns = [*(x[context] for x in names), self.ids[following]]
            listed = np.unique(context)
            listed_columns = [x[listed] for x in names]
            self.asked.append((at, inverse, first, columns, listed_columns))
            if k > answered:
                break
            total, n_after, d_after = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(listed), dtype=np.int64), np.zeros(len(listed), dtype=np.int64)
            for bucket, rows in dealt(columns, buckets):
                total[rows] = unpack(answers[2 * k][bucket])[0]
            for bucket, rows in dealt(listed_columns, buckets):
                n_after[rows], d_after[rows] = unpack(answers[2 * k + 1][bucket])
            state = np.searchsorted(listed, context)
            n, d = n_after[state][inverse], d_after[state][inverse]
            kept = n > 0
            self.probability[at[kept]] = ((total[inverse] + d * self.probability[at]) / np.maximum(n + d, 1))[kept]
            frequent, name = np.zeros(len(self.codes), dtype=bool), np.zeros(len(self.codes), dtype=np.int64)
            # a successor of this order is a context of the next
            frequent[at], name[at] = total[inverse] >= LEAST, inverse
            names = columns

    def questions(self, k: int, buckets: int, train: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """kind, bucket, data for the contexts of k words."""
        at, inverse, first, columns, listed = self.asked[k - 1]
        counts = np.bincount(inverse[(train & self.own)[at]], minlength=len(first)) if len(first) else np.zeros(0, dtype=np.int64)
        fine = np.round(-np.log(self.probability[at[first]]) * FINE).astype(np.int64)
        for bucket, rows in dealt(columns, buckets):
            yield 2 * k, bucket, pack(*(c[rows] for c in columns), counts[rows], fine[rows])
        for bucket, rows in dealt(listed, buckets):
            yield 7, bucket, pack(*(c[rows] for c in listed))


def each_block(batches: Iterator[pa.RecordBatch], buckets: int, tokens: int, distinct: int, answered: int) -> Iterator[tuple[Block, dict]]:
    """Rows sorted by block and kind: each block, with its answers for contexts of up to answered words."""
    row, answers = None, {}

    def made() -> tuple[Block, dict]:
        return Block(row["data"], row["sizes"], answers, buckets, tokens, distinct, answered), row

    for b in batches:
        for i in range(b.num_rows):
            kind = b["kind"][i].as_py()
            if kind == 0:
                if row is not None:
                    yield made()
                row, answers = {c: b[c][i].as_py() for c in b.schema.names}, {}
            else:
                answers.setdefault(kind, {})[b["bucket"][i].as_py()] = b["data"][i].as_py()
    if row is not None:
        yield made()


def score_texts(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == PART, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    blocks = stored(rows.mapInArrow(make_blocks(block), f"{BLOCKS}, sizes binary"), "lm-blocks")
    words = blocks.select(F.coalesce(F.sum(F.size("uid")), F.lit(0)), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    buckets = max(1, -(-int(words[1]) // bucket))  # about a byte a token when packed
    texts = blocks.drop("words", "counts")
    empty = {c: F.lit(None).cast(t) for c, t in texts.dtypes if c not in ("block", "kind", "bucket", "data")}

    def reduced(asked: DataFrame, how: Callable, name: str) -> DataFrame:
        return stored(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(how, MESSAGE), name)

    told = reduced(blocks.select("block", "words", "counts").mapInArrow(answer_words(buckets), MESSAGE), sum_words(buckets), "lm-words")
    totals = [unpack(r["data"]) for r in told.where("kind = 9").select("data").toLocalIterator()]  # two numbers a bucket
    tokens, distinct = (sum(int(t[i][0]) for t in totals) for i in (0, 1))
    answers = told.where("kind = 1")
    parts = max(1, blocks.count())

    def gathered() -> DataFrame:
        return texts.unionByName(answers.withColumns(empty)).repartition(parts, "block").sortWithinPartitions("block", "kind")

    def ask(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, row in each_block(batches, buckets, tokens, distinct, k - 1):
                train = np.repeat(~np.array(row["held_out"]), b.sizes)
                out = [(row["block"], *q) for q in b.questions(k, buckets, train)]
                if out:
                    yield messages(out)

        return run

    for k in range(1, DEPTH + 1):
        asked = stored(gathered().mapInArrow(ask(k), MESSAGE), "lm-asked")
        sums = reduced(asked.where(F.col("kind") == 2 * k), sum_successors(k, buckets), "lm-successors")
        contexts = reduced(asked.where("kind = 7").unionByName(sums.where("kind = 8")), sum_contexts(k), "lm-contexts")
        answers = answers.unionByName(sums.where(F.col("kind") == 2 * k)).unionByName(contexts)
        dropped(asked)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row in each_block(batches, buckets, tokens, distinct, DEPTH):
            starts = np.cumsum(b.sizes) - b.sizes
            base, score = (np.add.reduceat(np.where(b.own, np.log10(p), 0.0), starts) for p in (b.base[b.codes], b.probability))
            known, size = (np.add.reduceat((b.own & x).astype(np.int64), starts) for x in (b.known, True))
            columns = [pa.array(row["uid"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(size), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = gathered().mapInArrow(finish, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("uid", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
