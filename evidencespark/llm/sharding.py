"""Sharding by extendible hashing, in DataFrame operations only.

A row's address is the md5 of its key, read from the highest bit. The directory
starts with one bucket of depth 0; a bucket over the byte limit, and only such a one, splits on the
next bit. Bytes are summed per cell of MAX_DEPTH bits first, so the directory is built from
one small row per cell: bucket (d, prefix) is final when it is within the limit and its parent is not.
Only the cells still over the limit are split further, on all 128 bits.

Defined results: null text has 0 bytes; a null key has the address of the empty string; rows of one
key share an address and can't be parted, so a bucket of one address over the limit stays whole, at MAX_DEPTH or at
the first depth beyond at which it is alone, and is marked over_limit; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS_BITS, KEY_BITS = 32, 128
MAX_DEPTH = 24
SHARD_BYTES = 256 * 1024


def address(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def address_bits(key: Column) -> Column:
    """All 128 bits of the address as a text of 0 and 1."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.concat(*(F.lpad(F.conv(F.substring(digest, at, 8), 16, 2), 32, "0") for at in (1, 9, 17, 25)))


def directory(sized: DataFrame, limit: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """sized: address long, n_bytes long. One row per shard: depth, prefix, shard_bytes, shard_rows, over_limit."""
    shift = ADDRESS_BITS - max_depth
    cells = sized.groupBy(F.shiftright("address", shift).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    levels = cells.select(F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "cell", "bytes", "rows")
    buckets = levels.groupBy("depth", F.expr(f"shiftright(cell, {max_depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    split = buckets.where((F.col("shard_bytes") > limit) & (F.col("depth") < max_depth)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == max_depth)
    below = buckets.where(fits & (F.col("depth") > 0)).withColumn("parent", F.expr("prefix div 2"))
    return below.join(split, ["depth", "parent"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_rows").unionByName(
        buckets.where(fits & (F.col("depth") == 0)).select("depth", "prefix", "shard_bytes", "shard_rows")
    ).withColumn("over_limit", F.col("shard_bytes") > limit)


def deep_directory(left: DataFrame, limit: int, max_depth: int) -> DataFrame:
    """left: bits, n_bytes, the rows of the cells of max_depth bits that are over the limit. One row per address that lies in a bucket
    beyond max_depth: bits, deep_depth, deep_bytes. A bucket splits while it is over the limit and holds two addresses."""
    keys = left.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"))
    levels = keys.select("bits", "bytes", F.explode(F.sequence(F.lit(max_depth), F.lit(KEY_BITS))).alias("deep_depth")).withColumn("prefix", F.expr("substring(bits, 1, deep_depth)"))
    buckets = levels.groupBy("prefix").agg(F.sum("bytes").alias("deep_bytes"), F.count(F.lit(1)).alias("addresses"))
    final = levels.drop("bytes").join(buckets.where((F.col("deep_bytes") <= limit) | (F.col("addresses") == 1)), "prefix")
    first = final.groupBy("bits").agg(F.min(F.struct("deep_depth", "deep_bytes")).alias("f")).select("bits", "f.*")
    return first.where(F.col("deep_depth") > max_depth)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits), depth, shard_bytes, over_limit: one row for each row of docs.

    A shard's depth is looked up by the cell of the deepest directory that a row falls in: each cell lies in exactly one
    shard, so rows of any size of shard meet it by an equality join on the cell."""
    sized = docs.select("doc_id", address(F.col("doc_id")).alias("address"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    shift = ADDRESS_BITS - max_depth
    cells = sized.select(F.shiftright("address", shift).alias("cell")).distinct()
    depths = F.sequence(F.lit(0), F.lit(max_depth))
    found = (
        cells.select("cell", F.explode(depths).alias("depth"))
        .withColumn("prefix", F.expr(f"shiftright(cell, {max_depth} - depth)"))
        .join(directory(sized, limit, max_depth), ["depth", "prefix"])
        .select("cell", "depth", "prefix", "shard_bytes", "over_limit")
    )
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')"))
    placed = sized.withColumn("cell", F.shiftright("address", shift)).join(found, "cell")
    placed = placed.withColumn("bits", F.when(F.col("over_limit") & (F.col("depth") == max_depth), address_bits(F.col("doc_id"))))
    deep = deep_directory(placed.where("bits is not null").select("bits", "n_bytes"), limit, max_depth)
    further = F.col("deep_depth").isNotNull()
    # Rows without bits keep keys of their own, so that they do not all meet under null.
    placed = placed.withColumn("bits", F.coalesce("bits", F.col("address").cast("string")))
    return placed.join(deep, "bits", "left").select(
        "doc_id", "n_bytes",
        F.when(further, F.expr("substring(bits, 1, deep_depth)")).otherwise(name).alias("shard"),
        F.coalesce("deep_depth", "depth").cast("int").alias("depth"),
        F.coalesce("deep_bytes", "shard_bytes").alias("shard_bytes"),
        F.when(further, F.col("deep_bytes") > limit).otherwise(F.col("over_limit")).alias("over_limit"),
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """docs as Parquet, one folder a shard. Keys must be unique, as doc_id is."""
    placed = docs.join(assign_shards(docs, limit).select("doc_id", F.concat(F.lit("b"), "shard").alias("shard")), "doc_id")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
with sized as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as address
  from documents),
buckets as (
  select d.depth::int as depth, (address >> ({ADDRESS_BITS} - d.depth)::int) as prefix, sum(n_bytes)::bigint as shard_bytes
  from sized, range(0, {MAX_DEPTH + 1}) d(depth) group by 1, 2),
placed as (
  select s.doc_id, s.n_bytes, s.address, min(b.depth) as depth
  from sized s, buckets b
  where b.prefix = (s.address >> ({ADDRESS_BITS} - b.depth)) and (b.shard_bytes <= {SHARD_BYTES} or b.depth = {MAX_DEPTH})
  group by s.doc_id, s.n_bytes, s.address)
select p.doc_id, p.n_bytes,
       case when p.depth = 0 then '' else right(lpad(bin(b.prefix), 64, '0'), p.depth) end as shard,
       p.depth, b.shard_bytes, b.shard_bytes > {SHARD_BYTES} as over_limit
from placed p join buckets b on b.depth = p.depth and b.prefix = (p.address >> ({ADDRESS_BITS} - p.depth))
"""
