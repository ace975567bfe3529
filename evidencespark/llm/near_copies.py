"""Near copies: SimHash candidates, completed to all pairs of texts that share at least 4/5 of their five-word shingles.

A node is a distinct text. Candidates come from the fingerprints of simhash over five-word shingles, at up to two differing bits,
and are confirmed on the whole shingle sets. Texts at a Jaccard similarity of 0.8 differ in about ten of 64 bits, which
no one-wildcard segment index of a bearable size reaches, so the rest comes through an index of shingles.

The shingles of a node stand in one order over all texts: those found often in a sample of the texts last, then by hash. Two sets
of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of either (prefix filter), whatever the order is, so no
pair is lost; the order only keeps common lines out of the prefixes. All shingles up to the lesser of two prefixes' ends
are in the index, so the number of shared ones bounds the overlap of the sets; what passes is confirmed on the whole sets.

Under a shingle, each node is compared with one leader first. What that links is one component; then all pairs of nodes of different
components are compared, once for shingles that the same nodes share and once for a run of shingles that two nodes share. So a large
group of near copies costs few pairs, and a component is that of all pairs.

Defined results: null and blank texts are copies of each other; fewer words than a shingle: the whole sequence is one
shingle; null doc_ids come last in their component; each component keeps exactly one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import bounded_batches, each_text, list_array, stored
from .simhash import components, shingle_hashes

SHINGLE = 5
#: Texts and common shingles of the sample that orders shingles; neither changes the result.
SAMPLE_TEXTS, COMMON, COMMON_FROM = 20_000, 200_000, 2


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, rising, as signed 64-bit values; a text without words has the one value 0."""
    return np.unique(np.array(shingle_hashes(text, shingle) or [0], dtype="u8").view("i8"))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set: those not in common (rising; rank: how common) first, each by hash."""
    n = len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, rank[at], 0)))]
    return hashes[: n - -(-4 * n // 5) + 1]


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_sets(text: pa.Array) -> pa.Array:
    return list_array([shingle_set(t) for t in each_text(text)], pa.int64())


def node(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """texts: node, text. The most common shingles of a sample of distinct texts, rising, and their counts."""
    share = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.where(F.pmod("node", F.lit(share)) == 0).dropDuplicates(["node"])
    counts = sample.select(F.explode(shingle_sets("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_FROM)
    with bounded_batches(texts.sparkSession):
        rows = counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()
    rows.sort()
    return np.array([r["key"] for r in rows], dtype="i8"), np.array([r["n"] for r in rows], dtype="i8")


def _may_reach(x: Column, y: Column) -> Column:
    """Sets that meet at a shingle can share 4/5: by their sizes, and by what is left of both after its place, as a pair is kept at
    the first shingle that it shares. x, y: size * 2**32 + place."""
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    left = F.least(n - x.bitwiseAND(F.lit(2**32 - 1)), m - y.bitwiseAND(F.lit(2**32 - 1)))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * left >= 4 * (n + m))


def _likely(pairs: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that the shared shingles of their prefixes do not rule out. Up to the end of the prefix that ends first, all
    shingles of both sets are known, so the overlap is at most those shared and what the set has after its prefix."""
    known = nodes.select("node", "n", "last").join(shared.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    both = pairs.join(known.toDF("a", "n", "x_last", "x"), "a").join(known.toDF("b", "m", "y_last", "y"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    after = F.when(F.col("x_last") <= F.col("y_last"), F.expr("(4 * n + 4) div 5 - 1")).otherwise(F.expr("(4 * m + 4) div 5 - 1"))
    return both.where(9 * (F.col("shared") + after) >= 4 * (F.col("n") + F.col("m"))).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of nodes whose sets have Jaccard similarity 0.8 or more."""
    pairs = stored(pairs.distinct(), "near-pairs")
    members = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-members")
    sets = texts.join(members, "node", "left_semi").dropDuplicates(["node"]).select("node", shingle_sets("text").alias("set"))
    sets = stored(sets, "near-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stored(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "near-links")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes, at most two a node: with the least of its fingerprint, and that with the least of a component of linked ones."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    least = stored(least, "near-fingerprints")
    found = components(simhash.links(least.select("fp")))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = found.join(least.toDF("node", "x"), "node").join(least.toDF("component", "y"), "component").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return same.unionByName(near)


def _open(known: DataFrame) -> DataFrame:
    """The rows of known under shingles that nodes of different components share, one shingle, the first in their order, for all that
    have the same nodes; before: the node's shingle before this one of those left. Nodes that meet here and at one and the same
    shingle before met there already, so only meetings after different ones are new."""
    spread = [F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct("node", "place")).alias("first")]
    same = [F.count(F.lit(1)).alias("members"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    keys = known.groupBy("key").agg(*spread, *same).where("least <> most")
    keys = keys.groupBy("first.node", "members", "x", "y").agg(F.min(F.struct("first.place", "key")).alias("k")).select("k.key")
    return known.join(keys, "key", "left_semi").withColumn("before", F.lag("key").over(Window.partitionBy("node").orderBy("place")))


def links(docs: DataFrame) -> DataFrame:
    """Links a, b of nodes, enough of them to connect all that are similar; none that are not."""
    texts = docs.select(node().alias("node"), "text")
    common, rank = common_shingles(texts)

    @F.arrow_udf("struct<fp: long, n: int, keys: array<long>, last: struct<rank: long, key: long>>")
    def marked(texts: pa.Array) -> pa.Array:
        fp, n, keys, often = [], [], [], []
        for text in each_text(texts):
            hashes = shingle_hashes(text, SHINGLE)
            found = np.unique(np.array(hashes or [0], dtype="u8").view("i8"))
            fp.append(simhash.folded(hashes))
            n.append(len(found))
            keys.append(prefix(found, common, rank))
            at = min(int(np.searchsorted(common, keys[-1][-1])), len(common) - 1)
            often.append(int(rank[at]) if len(common) and common[at] == keys[-1][-1] else 0)
        last = pa.StructArray.from_arrays([pa.array(often, pa.int64()), pa.array([x[-1] for x in keys], pa.int64())], ["rank", "key"])
        return pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(n, pa.int32()), list_array(keys, pa.int64()), last], ["fp", "n", "keys", "last"])

    seen = texts.select("node", marked("text").alias("m")).select("node", "m.*")
    nodes = stored(seen.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "keys", "last"))), "near-nodes")
    index = nodes.select("node", F.posexplode("keys").alias("at", "key"), "n").select("key", "node", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"))
    of_key = Window.partitionBy("key")
    ranked = index.select("*", F.count(F.lit(1)).over(of_key).alias("members"), F.min("node").over(of_key).alias("leader"))
    shared = stored(ranked.where("members > 1").drop("members"), "near-shared")

    lead = shared.where("node = leader").select("key", F.col("place").alias("other"))
    near = shared.where("node <> leader").join(lead, "key").where(_may_reach(F.col("place"), F.col("other")))
    pairs = near.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    first = _confirmed(_likely(pairs, shared, nodes).unionByName(_by_fingerprint(nodes)), texts)

    known = shared.select("key", "node", "place").join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "near-known")
    left = stored(_open(known), "near-open")
    right = left.select(*(F.col(c).alias(f"o_{c}") for c in left.columns))
    meet = (F.col("key") == F.col("o_key")) & (F.col("node") > F.col("o_node")) & (F.col("component") != F.col("o_component"))
    new = F.col("before").isNull() | F.col("o_before").isNull() | (F.col("before") != F.col("o_before"))
    rest = left.join(right, meet & new & _may_reach(F.col("place"), F.col("o_place"))).select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()
    return first.unionByName(_confirmed(_likely(rest, shared, nodes), texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (nulls last, then by a hash of the row); columns unchanged."""
    found = components(links(docs))
    row = F.xxhash64(*docs.columns)
    ids = docs.select(node().alias("node"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row.alias("row")).alias("id"))
    best = ids.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("id").alias("id"))
    once = docs.withColumn("__row", row).join(best.select(F.col("id.row").alias("__row")), "__row", "left_semi")
    repeated = Window.partitionBy("__row").orderBy("doc_id")
    return once.withColumn("__n", F.row_number().over(repeated)).where("__n = 1").select(*docs.columns)
