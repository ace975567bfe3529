"""Job progress as streams: log lines to stages, changes only, latest state, cancelled jobs dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

# What log lines say, in the order in which they are tried; the stage they tell of, and its percentage.
TOTAL_LINE = r"(\d+) páginas a procesar"
SHARE_LINE = r"Qwen progreso: (\d+)/(\d+) \(([\d.]+)%\)"
STAGES = (
    (TOTAL_LINE, "Convirtiendo PDF", 3), ("Pasada 1: PaddleOCR", "PaddleOCR", 8), ("Pasada 1 completada", "PaddleOCR completado", 55), ("no se necesita Qwen", "Segmentación", 90),
    ("Pasada 2: Qwen fallback", "Qwen fallback", 58), (SHARE_LINE, None, None), (r"(?i:segment_document)|Segmentación", "Segmentación", 90), (r"\[subprocess_wrapper\] OK", "OCR completado", 91),
)
SHARE_FROM, SHARE_SCALE, SHARE_CAP = 58, 0.30, 88


def stage_of(line: Column) -> Column:
    """stage, pct, total (of pages, where the line states it); all null for a line that tells of no stage. A share of pages done is
    scaled into the part of the job that it stands for."""
    share = F.regexp_extract(line, SHARE_LINE, 3).try_cast("double")
    scaled = F.least(F.lit(SHARE_CAP), SHARE_FROM + F.floor(share * SHARE_SCALE).cast("int"))
    named = F.concat(F.lit("Qwen "), F.regexp_extract(line, SHARE_LINE, 1), F.lit("/"), F.regexp_extract(line, SHARE_LINE, 2))
    found = F.lit(None).cast("struct<stage: string, pct: int>")
    for pattern, name, pct in reversed(STAGES):
        hit = F.struct((F.lit(name) if name else named).alias("stage"), (F.lit(pct) if name else scaled).cast("int").alias("pct"))
        found = F.when(line.rlike(pattern), hit).otherwise(found)
    return F.struct(found["stage"].alias("stage"), found["pct"].alias("pct"), F.regexp_extract(line, TOTAL_LINE, 1).try_cast("int").alias("total"))


def parse_progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Works on a batch and on a stream."""
    return lines.withColumn("__s", stage_of(F.col(column))).select("*", "__s.*").drop("__s")


def emit_changes(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Batch form: rows whose values differ from those of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    return df.withColumn("__before", F.lag(now).over(w)).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(now)).drop("__before")


def emit_changes_stream(stream: DataFrame, key: str, time: str, value: str, terminal: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """Stream form: key, time, value where the value is another than the last sent; the state of a job (one value) goes at a terminal one
    or after an hour of event time without news."""

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for t, v in sorted(zip(pdf[time], pdf[value])):
                if v != last:
                    out.append((k[0], t, v))
                    last = v
        if last in terminal:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        yield pd.DataFrame(out, columns=[key, time, value])

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(time, "10 minutes").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, {value} string", "last string", "append", "EventTimeTimeout")


def latest_state(df: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """The last non-null of each value by time."""
    return df.groupBy(key).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(time))).alias(v) for v in values), F.max(time).alias(time))


class _Changes(StatefulProcessor):
    """The last value sent of each job, cleared at a terminal one or after an hour of event time without news."""

    def __init__(self, key: str, time: str, value: str, terminal: tuple[str, ...], idle_ms: int):
        self.key, self.time, self.value, self.terminal, self.idle_ms = key, time, value, terminal, idle_ms

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "value string")

    def _clear(self) -> None:
        self.last.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = sorted((t, v, ms) for pdf in rows for t, v, ms in zip(pdf[self.time], pdf[self.value], pdf["event_ms"]))
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t, v, _ in news:
            if v != last:
                out.append((key[0], t, v))
                last = v
        self._clear()
        if last not in self.terminal:
            self.last.update((last,))
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), news[-1][2]) + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.time, self.value])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def close(self) -> None:
        pass


def emit_changes_with_timers(stream: DataFrame, key: str, time: str, value: str, terminal: tuple[str, ...] = ("done", "error"), late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """As emit_changes_stream, with a timer for each job instead of a timeout; rows older than the watermark are not seen. The session's state
    store has to be one with column families (RocksDB)."""
    kind = dict(stream.dtypes)[key]
    keyed = stream.withColumn("event_ms", F.unix_millis(time)).withWatermark(time, late).groupBy(key)
    return keyed.transformWithStateInPandas(_Changes(key, time, value, terminal, idle_ms), f"{key} {kind}, {time} timestamp, {value} string", "Append", "EventTime")


#: Buckets of the table of latest states; a batch rewrites those that it touches.
STATE_BUCKETS = 64


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, version long, epoch long").parquet(f"{path}/pointers")


def merge_latest(batch: DataFrame, epoch: int, key: str, time: str, values: list[str], path: str, buckets: int = STATE_BUCKETS) -> None:
    """Merges a batch into the table of latest states under path: each value with the time that it is of, in buckets by key. The buckets
    that the batch touches are written anew; then, in one small file, which version of each bucket holds. An epoch is merged with the latest one before it,
    so one that comes again gives the same, and one that is left out loses nothing."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    named = [c for v in values for c in (F.col(v), F.when(F.col(v).isNotNull(), F.col(time)).alias(f"{v}__at"))]
    new = batch.select(bucket, F.col(key), *named)
    before = _pointers(spark, path).where(F.col("epoch") < epoch)
    last = before.agg(F.max("epoch")).first()[0]
    held = {r["bucket"]: r["version"] for r in before.where(F.col("epoch") == last).collect()}  # a row a bucket
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    old = [f"{path}/states/version={held[b]}/bucket={b}" for b in touched if b in held]
    if old:
        new = new.unionByName(spark.read.option("basePath", path + "/states").schema(new.schema).parquet(*old).select(*new.columns))
    merged = new.groupBy("bucket", key).agg(*(x for v in values for x in (F.max_by(v, f"{v}__at").alias(v), F.max(f"{v}__at").alias(f"{v}__at"))))
    if touched:
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/states/version={epoch}")
    rows = [(b, v) for b, v in (held | dict.fromkeys(touched, epoch)).items()]
    spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/epoch={epoch}")


def start_latest(spark: SparkSession, path: str) -> None:
    """An empty table of latest states, unless there is one."""
    spark.createDataFrame([], "bucket int, version long").write.mode("ignore").parquet(f"{path}/pointers/epoch=-1")


def read_latest(spark: SparkSession, path: str, key: str, time: str, kinds: str) -> DataFrame:
    """The table of latest states: key, values, time (the latest of any). kinds: the schema of key and values with their types, and of time."""
    pointers = _pointers(spark, path)
    last = pointers.agg(F.max("epoch")).first()[0]
    paths = [f"{path}/states/version={r['version']}/bucket={r['bucket']}" for r in pointers.where(F.col("epoch") == last).collect()]
    fields = spark.createDataFrame([], kinds).schema.fields
    values = [f.name for f in fields if f.name not in (key, time)]
    at = next(f for f in fields if f.name == time).dataType
    schema = T.StructType([f for f in fields if f.name != time] + [T.StructField(f"{v}__at", at) for v in values])
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.select(key, *values, F.greatest(*(F.col(f"{v}__at") for v in values), F.lit(None).cast(at)).alias(time))


def upsert_latest(stream: DataFrame, key: str, time: str, values: list[str], path: str):
    """A query that keeps the latest of each value of each key in the table of states under path."""
    start_latest(stream.sparkSession, path)
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_latest(batch, epoch, key, time, values, path))


def drop_cancelled(events: DataFrame, cancelled: DataFrame, key: str) -> DataFrame:
    """Batch or stream events without those of cancelled jobs (a static table)."""
    return events.join(cancelled.select(key).distinct(), key, "left_anti")


def append_log(lines: DataFrame, path: str, job: str = "job_id") -> None:
    """lines: job_id, ts, line. Appends them to a log kept by job, each with its time in front."""
    stamped = F.concat(F.date_format("ts", "[HH:mm:ss] "), F.col("line")).alias("line")
    lines.select(job, "ts", stamped).write.mode("append").partitionBy(job).parquet(path)
