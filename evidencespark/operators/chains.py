"""Sequences cut by a rule that looks at where the last cut fell, without a fold: running sums, successors, pointer doubling.

Work on one sequence is dealt over tasks: running sums over stretches of its numbers, successors over bins of the sums, and the chain of
cuts by joins whose number grows with the logarithm of its length. Sequences are told apart by a struct of their key, so a null key is one too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

STRETCH = 4096


def running_sums(rows: DataFrame, key: str, number: str, size: str, stretch: int = STRETCH) -> DataFrame:
    """rows with i (place in the key's order of number, from 0), upto (the sum of size through it), rows_in_key and total. number: whole numbers."""
    parts = rows.withColumn("__stretch", F.floor(F.col(number) / stretch))
    sums = parts.groupBy(F.col(key).alias("__key"), F.col("__stretch").alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__sum"))
    before, whole = Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__key")
    sums = sums.select(
        "__key", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__below"),
        F.sum("__n").over(whole).alias("rows_in_key"), F.sum("__sum").over(whole).alias("total"),
    )
    own = Window.partitionBy(key, "__stretch").orderBy(number, size)
    placed = parts.withColumns({"__r": F.row_number().over(own), "__t": F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    out = placed.join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("__stretch").eqNullSafe(F.col("__s")))
    return out.withColumns({"i": F.col("__before") + F.col("__r") - 1, "upto": F.col("__below") + F.col("__t")}).drop("__stretch", "__r", "__t", "__key", "__s", "__before", "__below")


def first_beyond(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, i, upto, size) of rising upto with beyond: the least i whose upto is over most more than what lies before the row, null
    if there is none. A lookup in a sorted list, dealt by bins of most: the row's own bin first, else the next one that has a row."""
    start = F.col("upto") - F.col("size")
    ends = rows.select(key, F.col("upto").alias("v"), F.lit(0).alias("probe"), "i")
    probes = rows.select(key, (start + most).alias("v"), F.lit(1).alias("probe"), "i")
    both = ends.unionByName(probes).withColumn("bin", F.floor(F.col("v") / most))
    end = F.when(F.col("probe") == 0, F.col("i"))
    near = F.min(end).over(Window.partitionBy(key, "bin").orderBy(F.desc("v"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, 0))
    bins = both.groupBy(F.col(key).alias("__key"), F.col("bin").alias("__bin")).agg(F.min(end).alias("__least"))
    later = F.min("__least").over(Window.partitionBy("__key").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("__key", "__bin", later.alias("__later"))
    asked = both.withColumn("near", near).where("probe = 1")
    return asked.join(bins, (F.col(key) == F.col("__key")) & (F.col("bin") == F.col("__bin"))).select(key, "i", F.coalesce("near", "__later").alias("beyond"))


def reachable(steps: DataFrame, key: str) -> DataFrame:
    """steps: key, i, to (over i; none for the last). key, i of all places that are reached from place 0: each round joins the places
    marked so far with jumps twice as long as those before, until no jump is left."""
    jump = stored(steps.select(key, "i", "to"), "jumps")
    marked = steps.select(key).distinct().withColumn("i", F.lit(0).cast("long"))
    while not jump.isEmpty():
        marked = stored(marked.unionByName(marked.join(jump, [key, "i"]).select(key, F.col("to").alias("i"))), "marked")
        onward = jump.select(key, F.col("i").alias("to"), F.col("to").alias("end"))
        jump = stored(jump.join(onward, [key, "to"]).select(key, "i", F.col("end").alias("to")), "jumps")
    return marked.distinct()
