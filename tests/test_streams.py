"""Streams with state: changes with timers, latest states through restarts, skipped epochs and late rows."""

import datetime as dt

import pytest

from evidencespark.streaming import progress

SCHEMA = "job int, ts timestamp, state string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, own)


def test_changes_with_timers(spark, rocks, tmp_path):
    """Repeats are not sent; a restart keeps the last value; a job begins anew after its end and after an hour without news; late rows are not seen."""

    def batch(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = progress.emit_changes_with_timers(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "job", "ts", "state")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    batch([(1, at(0), "run"), (1, at(1), "run"), (1, at(2), "page"), (2, at(0), "run")])
    batch([(1, at(3), "page"), (1, at(4), "done"), (2, at(5), "run"), (3, at(30), "run")])
    batch([(1, at(31), "done"), (3, at(2), "late"), (4, at(200), "run")])
    batch([(2, at(201), "run"), (4, at(202), "run")])
    got = sorted((r["job"], r["ts"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, at(0), "run"), (1, at(2), "page"), (1, at(4), "done"), (1, at(31), "done"), (2, at(0), "run"), (2, at(201), "run"), (3, at(30), "run"), (4, at(200), "run")]


KINDS = "job int, state string, pct int, ts timestamp"


def latest(spark, path):
    return {r["job"]: (r["state"], r["pct"], r["ts"]) for r in progress.read_latest(spark, path, "job", "ts", KINDS).collect()}


def test_latest_states_through_skipped_and_repeated_epochs(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = lambda rows, epoch: progress.merge_latest(spark.createDataFrame(rows, KINDS), epoch, "job", "ts", ["state", "pct"], path, 4)
    progress.start_latest(spark, path)
    assert latest(spark, path) == {}
    merge([(1, "run", None, at(1)), (2, "run", 5, at(1)), (1, None, 10, at(5))], 0)
    assert latest(spark, path) == {1: ("run", 10, at(5)), 2: ("run", 5, at(1))}
    late = [(1, "page", 7, at(3)), (3, "run", None, at(9))]
    for epoch in (2, 2, 5):  # 1 left out, 2 again, 3 and 4 left out; the state of minute 3 is later than that of 1, the share is not
        merge(late, epoch)
        assert latest(spark, path) == {1: ("page", 10, at(5)), 2: ("run", 5, at(1)), 3: ("run", None, at(9))}
    merge([], 6)
    progress.start_latest(spark, path)
    assert len(latest(spark, path)) == 3


def test_latest_states_of_a_stream_with_a_restart(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    spark.createDataFrame([(1, "run", 1, at(0)), (2, "run", None, at(0))], KINDS).write.parquet(source)
    for rows in ([], [(1, None, 2, at(4)), (1, "done", None, at(3))]):
        if rows:
            spark.createDataFrame(rows, KINDS).write.mode("append").parquet(source)
        q = progress.upsert_latest(spark.readStream.schema(KINDS).parquet(source), "job", "ts", ["state", "pct"], path).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert latest(spark, path) == {1: ("done", 2, at(4)), 2: ("run", None, at(0))}
