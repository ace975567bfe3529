"""The recipes that make persons, experiences, pages and works of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = ("1998-03-16", "1999-12-31")
PROPOSAL = "2002-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as experiences of customers: the end is the last shipment, none for open orders; issued 60 days after the order."""
    ships = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("ship"))
    o = read(spark, sf_dir, "orders").join(ships, "o_orderkey", "left")
    start = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("experience"), start.alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("ship")).alias("end_date"), F.date_add(start, 60).alias("cert_issue_date"), "o_orderpriority", "o_totalprice",
    )


#: doc_ids of a bucket in which pages are numbered.
PAGE_BUCKET = 4096


def numbered(docs: DataFrame) -> DataFrame:
    """docs (source, doc_id, ...) with page_num: documents as pages of their source, numbered by doc_id, those without one last. Sources may hold a
    third of all rows, so a row is numbered inside its bucket of doc_ids, and a small table has the pages of the source before each bucket.
    All columns of docs are shuffled once: leave out texts where what is made of them will do."""
    docs = docs.withColumn("bucket", F.floor(F.col("doc_id") / PAGE_BUCKET))
    counts = docs.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy(F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("s", "b", before.alias("before"))
    n = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("doc_id"))
    placed = docs.withColumn("n", n).join(counts, F.col("source").eqNullSafe(F.col("s")) & F.col("bucket").eqNullSafe(F.col("b")))
    return placed.withColumn("page_num", (F.col("before") + F.col("n")).cast("int")).drop("bucket", "n", "s", "b", "before")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, page_num, doc_id, text."""
    return numbered(documents(spark, sf_dir)).select("source", "page_num", "doc_id", "text")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


EXPERIENCES_SQL = """
experiences as (
  select o_custkey as person, o_orderkey as experience, o_orderdate::date as start_date,
         case when o_orderstatus <> 'O' then ship end as end_date, o_orderdate::date + 60 as cert_issue_date, o_orderpriority, o_totalprice
  from orders left join (select l_orderkey, max(l_shipdate)::date as ship from lineitem group by 1) on l_orderkey = o_orderkey)"""
PAGES_SQL = "pages_t as (select source, row_number() over (partition by source order by doc_id) as page_num, doc_id, coalesce(text, '') as text from documents)"
