"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

Sizes are counted in words. The mix is dealt in equal blocks of words, BLOCK_WORDS or fewer, so that the smallest target has SMALLEST_BLOCKS of
them or they are single words: sources get integer numbers of
blocks by highest quotients target / (2k + 1); each source is cut by a seeded hash into shards of bounded
size, a source's blocks are dealt to its shards in proportion to their words, and inside a shard the
documents stand in seeded order, cut into blocks. Every block is taken quota div blocks times; of the rest,
a run of neighbouring blocks from a seeded start on is taken once more, so that nearly all documents are
taken whole.

Only one row per source reaches the driver (target weights are a parameter per source as well).

Defined results: null text has size 0; null is a source of its own, last in order; sources without words
have target 0; repeated rows count as documents each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS, SMALLEST_BLOCKS = 16, 64
SHARD_WORDS = 250_000
#: Rows of the table of sources up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int


def cycled(names: Sequence[str | None]) -> dict[str | None, float]:
    """Weights 5, 2, 1, repeating, over the sources by code point, null last."""
    ordered = sorted((n for n in names if n is not None), key=lambda n: n.encode("utf-8")) + [None] * (None in names)
    return {n: float(WEIGHTS[i % len(WEIGHTS)]) for i, n in enumerate(ordered)}


def water_fill(sizes: dict, weights: dict, cap: int = CAP) -> dict:
    """Shares of the whole by weight, none above cap times its size; what a share is cut by goes to the others by weight."""
    total, targets = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0)
    free = [s for s in sizes if sizes[s] > 0]
    while free:
        unit = total / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit > cap * sizes[s]]
        for s in over or free:
            targets[s] = float(cap * sizes[s]) if over else weights[s] * unit
            total -= targets[s]
        free = [s for s in free if s not in set(over)] if over else []
    return targets


def sainte_lague(targets: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients t / (2k + 1), ties to the first. The start is what a divisor too large for all seats gives."""
    whole, n = sum(targets), sum(t > 0 for t in targets)
    won = [0] * len(targets)
    if whole <= 0 or seats <= 0:
        return won
    if seats > n:
        divisor = whole / (seats - n / 2) * (1 + 1e-12)
        won = [int(t / divisor + 0.5) if t > 0 else 0 for t in targets]
    heap = [(-t / (2 * won[i] + 1), i) for i, t in enumerate(targets) if t > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-targets[i] / (2 * won[i] + 1), i))
    return won


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def plan_sources(sized: DataFrame, weights: Callable[[Sequence[str | None]], dict] = cycled, cap: int = CAP, block: int = BLOCK_WORDS) -> tuple[list[Source], int]:
    """The sources and the words of a block. One row per source is collected."""
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = water_fill(sizes, weights(list(sizes)), cap)
    names = list(weights(list(sizes)))
    block = max(1, min(block, int(min((t for t in targets.values() if t > 0), default=block) // SMALLEST_BLOCKS)))
    won = sainte_lague([targets[n] for n in names], round(sum(targets.values()) / block))
    return [Source(n, sizes[n], targets[n], min(k, cap * -(-sizes[n] // block))) for n, k in zip(names, won)], block


def mix(sized: DataFrame, weights: Callable[[Sequence[str | None]], dict] = cycled, cap: int = CAP, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17, rows: DataFrame | None = None) -> DataFrame:
    """sized: doc_id, source, size (stored: it is read twice). One row for each of its rows: doc_id, size, source,
    source_size, target, copies (times the whole document is taken), runs (further word ranges [start, end) of it), taken.
    rows: the same documents with a column doc, which is carried along; totals are always those of sized."""
    spark = sized.sparkSession
    plan, block = plan_sources(sized, weights, cap, block)
    plain = [(i, s.name, s.size, s.target, s.blocks, max(1, -(-s.size // shard_words))) for i, s in enumerate(plan)]
    sources = spark.createDataFrame(plain, "no long, __source string, source_size long, target double, source_blocks long, shards long")
    sources = F.broadcast(sources) if len(plain) <= BROADCAST_SOURCES else sources

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(sources, F.col("source").eqNullSafe(F.col("__source"))).withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
        df = df.withColumn("order", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "size")).otherwise(F.col("order")))  # rows without an id are not one key
        return df.withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")))

    both = dealt(sized.select("doc_id", "source", "size") if rows is None else rows.select("doc_id", "source", "size", "doc"))
    cells = dealt(sized.select("doc_id", "source", "size")).groupBy("no", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("source_blocks").alias("source_blocks"))
    before = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.expr("cast(round(source_blocks * cast(through as decimal(20, 0)) / source_size) as long)")
    done = F.expr("cast(round(source_blocks * cast(through - cell_size as decimal(20, 0)) / source_size) as long)")
    cells = (
        cells.withColumn("through", F.sum("cell_size").over(before))
        .withColumn("quota", F.when(F.col("source_size") > 0, upto - done).otherwise(F.lit(0)))
        .withColumn("blocks", F.ceil(F.col("cell_size") / block))
        .select("no", "shard", "cell_size", F.least("quota", F.col("blocks") * cap).alias("quota"), "blocks")
    )
    in_cell = Window.partitionBy("no", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("end", F.sum("size").over(in_cell)).withColumn("start", F.col("end") - F.col("size")).join(cells, ["no", "shard"])
    placed = placed.withColumn("copies", F.expr("if(blocks > 0, quota div blocks, 0)")).withColumn("rest", F.expr("if(blocks > 0, quota % blocks, 0)"))
    placed = placed.withColumn("first", F.expr(f"if(blocks > 0, pmod(xxhash64({seed}, no, shard), blocks), 0)"))
    # The run of rest blocks from first on, around the end of the shard: at most two ranges of its words.
    ranges = F.array(
        F.struct((F.col("first") * block).alias("a"), F.least(F.least(F.col("first") + F.col("rest"), F.col("blocks")) * block, F.col("cell_size")).alias("b")),
        F.struct(F.lit(0).cast("long").alias("a"), (F.greatest(F.col("first") + F.col("rest") - F.col("blocks"), F.lit(0)) * block).alias("b")),
    )
    inside = F.transform(ranges, lambda r: F.struct((F.greatest(r["a"], F.col("start")) - F.col("start")).alias("start"), (F.least(r["b"], F.col("end")) - F.col("start")).alias("end")))
    placed = placed.withColumn("runs", F.filter(inside, lambda r: r["end"] > r["start"]))
    extra = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    carried = [] if rows is None else ["doc"]
    return placed.select(*carried, "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), "runs", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The digest of the mix: doc_id, size, source_size, target, taken."""
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs: a row for each whole copy, and one for each further range of words, with the text cut to it
    and n_chars, where there is one, counted anew. Documents without words are not in any mix."""
    columns = docs.columns
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*columns).alias("doc"))
    plan = mix(sized, rows=rows).where("taken > 0")
    whole = F.transform(F.expr("if(copies > 0, sequence(1, copies), array())"), lambda _: F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
    pieces = plan.select("doc", F.explode(F.concat(whole, "runs")).alias("__piece")).select("doc.*", "__piece")
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)  # white space before the first word is a piece of its own
    cut = F.concat_ws("", F.slice(words, (F.col("__piece.start") + 1 + lead).cast("int"), (F.col("__piece.end") - F.col("__piece.start")).cast("int")))
    out = pieces.withColumn("text", F.when(F.col("__piece.start") < 0, F.col("text")).otherwise(F.rtrim(cut)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
