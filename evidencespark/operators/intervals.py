"""Interval algebra: union of intervals, effective days with exclusions, stoppage periods, overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import overlap_days


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the intervals of each key: those that start at or before the latest end so far are joined."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", F.when(F.col(start) <= latest, 0).otherwise(1))
    islands = islands.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("__island")


#: Common windows up to which they are named in an expression; more are joined.
MAX_WINDOWS = 256


def effective_days(experiences: DataFrame, exclusions: DataFrame, person: str, experience: str, group: str | None = None) -> DataFrame:
    """experiences: person, experience, start, end, issued (the end where none is given), and group if exclusions have one.
    exclusions: start, end (and group): common windows of all, or those of a group. Per experience gross days (end exclusive) less the
    union of overlaps (both ends inclusive), at least 0. Returns person, experience, gross_days, excluded_days, days. A few common windows
    are united first and then subtracted in each row, without a join."""
    own = experiences.withColumn("end", F.coalesce("end", "issued")).where("start is not null and end is not null and end >= start")
    gross = F.datediff("end", "start")
    windows = None if group else exclusions.select(F.lit(0).alias("__all"), "start", "end").limit(MAX_WINDOWS + 1)
    common = None if group else merge_intervals(windows, ["__all"]).select("start", "end", "n_merged").collect()  # at most MAX_WINDOWS + 1 rows
    if common is not None and sum(w["n_merged"] for w in common) <= MAX_WINDOWS:
        shared = [F.greatest(F.lit(0), F.datediff(F.least("end", F.lit(w["end"])), F.greatest("start", F.lit(w["start"]))) + 1) for w in common]
        both = own.select(person, experience, gross.alias("gross_days"), sum(shared, F.lit(0)).cast("long").alias("excluded_days"))
        return both.withColumn("days", F.greatest(F.lit(0), F.col("gross_days") - F.col("excluded_days")).cast("long"))
    ex = exclusions.select(*([group] if group else []), F.col("start").alias("x_start"), F.col("end").alias("x_end"))
    meets = (F.col("x_start") <= F.col("end")) & (F.col("start") <= F.col("x_end"))
    if group:
        meets = meets & (own[group] == ex[group])
    hit = own.join(ex, meets).select(person, experience, F.greatest("start", "x_start").alias("start"), F.least("end", "x_end").alias("end"))
    excluded = merge_intervals(hit, [person, experience]).groupBy(person, experience).agg(F.sum(F.datediff("end", "start") + 1).alias("excluded_days"))
    both = own.select(person, experience, gross.alias("gross_days")).join(excluded, [person, experience], "left").withColumn("excluded_days", F.coalesce("excluded_days", F.lit(0)))
    return both.withColumn("days", F.greatest(F.lit(0), F.col("gross_days") - F.col("excluded_days")).cast("long"))


def effective_years(days: Column) -> Column:
    return F.bround(days / 365.25, 1)


def suspension_periods(months: DataFrame, keys: list[str], month: str = "month", stopped: str = "stopped", exact: str | None = None) -> DataFrame:
    """months: keys, month (its first day), stopped boolean, exact (a stop date, may be null). Islands of stopped months:
    start (the exact date where given), end (the first day of the next month, 31 December for December), months. A month at
    work closes a period, as does a gap of over 31 days."""
    start = F.coalesce(F.col(exact), F.col(month)) if exact else F.col(month)
    end = F.when(F.month(month) == 12, F.last_day(month)).otherwise(F.add_months(month, 1))
    order = Window.partitionBy(*keys).orderBy(month)
    rows = months.withColumns({"__start": start, "__end": end}).withColumn("__stop", F.coalesce(F.col(stopped), F.lit(False)))
    rows = rows.withColumn("__broken", F.sum(F.when(F.col("__stop"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__stop")
    inner = Window.partitionBy(*keys, "__broken").orderBy(month)
    last = F.max("__end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(F.datediff("__start", last) <= 31, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__broken", "__island").agg(F.min("__start").alias("start"), F.max("__end").alias("end"), F.count(F.lit(1)).alias("months")).drop("__broken", "__island")


#: Days of a bin of overlap_join: about the length of the longer intervals, so that most touch one bin or two.
OVERLAP_DAYS = 128


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], days: int = OVERLAP_DAYS) -> DataFrame:
    """Pairs of rows of equal keys whose intervals (start, end; both ends in) share a day. Intervals are cut into fixed bins of days and meet by
    key and bin, so that a key with many intervals is dealt over its bins; a pair that shares several bins is kept in that of its later start.
    Intervals with a null end meet none."""

    def cut(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        bins = [F.floor(F.unix_date(f(*ends)) / days) for f in (F.least, F.greatest)]
        return df.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()).withColumn("__bin", F.explode(F.sequence(*bins)))

    both = cut(left, a).join(cut(right, b), [*keys, "__bin"])
    meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    return both.where(meets & (F.col("__bin") == F.floor(F.unix_date(F.greatest(a[0], b[0])) / days))).drop("__bin")


def overlap_stoppages(certificates: DataFrame, stoppages: DataFrame, key: str, certificate: str) -> DataFrame:
    """Stopped months (key, start, end, days) that meet a certificate (key, certificate, start, end). Returns certificate, months, stopped_days,
    overlap_days."""
    s = stoppages.select(key, F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("days").alias("s_days"))
    hit = overlap_join(certificates, s, [key], ("start", "end"), ("s_start", "s_end"))
    return hit.groupBy(certificate).agg(F.count(F.lit(1)).alias("months"), F.sum("s_days").alias("stopped_days"), F.sum(overlap_days(F.col("start"), F.col("end"), F.col("s_start"), F.col("s_end"))).cast("long").alias("overlap_days"))
