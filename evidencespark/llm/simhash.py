"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most two bits have a
segment that differs in at most one: in none, and they share the whole segment, or in just one, and they share a variant of the
segment with that bit deleted (set to a wildcard), one with the bit and one without. Every distinct fingerprint is indexed under
its 2 segments and 2 x 32 variants; those of one segment meet under it, those of one variant where the deleted bit differs, and
meetings are verified by the number of differing bits. So fingerprints of one segment do not meet 32 times more under its variants.

A variant may be shared by very many fingerprints. Members are counted first, with map-side sums; all pairs are made only under a
variant of at most CROWD members. Fingerprints under a fuller one are indexed further, by the whole fingerprint and its 64
one-bit changes: two of them differ in at most two bits if and only if they share one of these keys, which at most 65 can
share, so a link of each to the smallest under the key loses nothing.

Nodes are distinct fingerprints, so copies are one node, with or without a doc_id. Components are found by alternating large-star and
small-star steps over the links.

Defined results: null and blank texts have fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence is one shingle; a repeated doc_id gets a row, and the component of its own text, each time; rows without a
doc_id link others like any row and get the component of their fingerprint (null if no row of it has a doc_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, stored

SHINGLE, SEED, MAX_BITS = 3, 42, 2
CROWD = 32
SEGMENT_BITS = 32
#: Fingerprints that a task indexes. A stored table of them is a few small files, which Spark reads in as few tasks, but makes 66 keys
#: of each.
FINGERPRINTS_A_TASK = 8192


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of all shingles; of the whole sequence where words are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())]


def folded(hashes: list[int]) -> int:
    """Signed 64-bit value; a bit is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):  # a bounded block of a long text at a time
        block = np.array(hashes[i : i + 65536], dtype=">u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return folded(shingle_hashes(text, shingle))


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in each_text(text)], pa.int64())


def variants(fp: str = "fp") -> str:
    """SQL for the array of a fingerprint's segments and variants, each as one number: place of the wildcard in the fingerprint (64 and 65:
    none, of a whole segment), segment without that bit."""
    def of(segment: int) -> str:
        value = f"({fp} & {(1 << SEGMENT_BITS) - 1}L)" if segment == 0 else f"shiftrightunsigned({fp}, {SEGMENT_BITS})"
        one_bit = f"transform(sequence(0, {SEGMENT_BITS - 1}), b -> shiftleft({segment * SEGMENT_BITS}L + b, {SEGMENT_BITS}) | ({value} & ~shiftleft(1L, b)))"
        return f"array(shiftleft({64 + segment}L, {SEGMENT_BITS}) | {value}), {one_bit}"

    return f"concat({of(0)}, {of(1)})"


#: The bit of a fingerprint that its variant lacks; null for a whole segment.
DELETED = f"if(shiftright(variant, {SEGMENT_BITS}) < 64, shiftrightunsigned(fp, cast(shiftright(variant, {SEGMENT_BITS}) as int)) & 1, null)"


def spread(nodes: DataFrame) -> DataFrame:
    """nodes, dealt by fp to tasks of about FINGERPRINTS_A_TASK rows."""
    return nodes.repartition(max(1, -(-nodes.count() // FINGERPRINTS_A_TASK)), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """nodes: fp long, distinct. Links a, b of fingerprints, enough of them to connect all that differ in at most MAX_BITS bits; none
    that differ in more."""
    index = spread(nodes).select("fp", F.explode(F.expr(variants())).alias("variant")).withColumn("bit", F.expr(DELETED))
    meets = F.coalesce(F.min("bit") < F.max("bit"), F.count(F.lit(1)) > 1)
    counts = stored(index.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), meets.alias("meets")).where("meets").drop("meets"), "simhash-counts")
    met = stored(index.join(counts, "variant"), "simhash-met")
    groups = met.where(F.col("n") <= CROWD).groupBy("variant").agg(F.collect_list(F.struct("fp", "bit")).alias("fps"))
    ones = groups.select(F.explode("fps").alias("own"), "fps")
    apart = F.filter("fps", lambda b: (F.col("own.fp") > b["fp"]) & ~F.coalesce(F.col("own.bit") == b["bit"], F.lit(False)) & (F.bit_count(F.col("own.fp").bitwiseXOR(b["fp"])) <= MAX_BITS))
    pairs = ones.select(F.col("own.fp").alias("a"), F.explode(apart).alias("other")).select("a", F.col("other.fp").alias("b"))

    crowded = met.where(F.col("n") > CROWD).select("fp").distinct()
    changes = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    keys = crowded.select("fp", F.explode(changes).alias("key"))
    stars = keys.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. One row for each node on an edge, but for the smallest of each component: node, component (that smallest node)."""
    edges = stored(edges.select("a", "b"), "component-edges")
    before = None
    while True:
        # Large star: neighbours above a node are linked to the smallest of it and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its neighbours below it are linked to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "component-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    marked = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash-fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    found = found.unionByName(found.select(F.col("component").alias("fp"), "component").distinct())  # the roots
    linked = stored(nodes.join(found, "fp").select("fp", "component", "least"), "simhash-linked")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
