"""What tasks hold, and what a Python worker keeps for the stages after its own."""

import time

import public_tokenizers
import pyarrow as pa

from evidencespark.llm import packing, simhash
from evidencespark.llm.common import stored
from evidencespark.llm.queries import WORD_TOKENIZER


def test_packing_leaves_no_encoder_in_a_worker(spark):
    def held(batches):
        from evidencespark.llm import encoding

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoding._encoders)] * b.num_rows, pa.int64())], ["held"])

    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER)).count() == 64
    workers = spark.range(0, 64, 1, 8).mapInArrow(held, "held long")
    assert {r["held"] for r in workers.collect()} == {0}


def test_an_index_of_fingerprints_is_dealt_to_small_tasks(spark, tmp_path):
    """A stored table of fingerprints is one file; its 66 keys a row are made by as many tasks as it has blocks of rows."""
    n = 3 * simhash.FINGERPRINTS_A_TASK
    spark.range(n).selectExpr("xxhash64(id) as fp").coalesce(1).write.parquet(str(tmp_path / "fps"))
    dealt = simhash.spread(spark.read.parquet(str(tmp_path / "fps")))
    sizes = [r["n"] for r in dealt.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 3 and sum(sizes) == n and max(sizes) < 2 * simhash.FINGERPRINTS_A_TASK


def test_a_stored_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffles()
    table = stored(spark.range(1000).repartition(4, "id"), "dealt")
    until = time.monotonic() + 5
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 1000
