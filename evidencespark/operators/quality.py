"""Extraction quality against golden rows: set metrics, micro averages, one-to-one matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import indel_ratio
from ..functions.similarity import sorted_words
from ..functions.text import strip_accents
from ..shared import shuffled, stored
from .assign import contained_texts, dominant_pairs, similar_candidates


def set_metrics(df: DataFrame, found: str, expected: str) -> DataFrame:
    """df with tp, fp, fn, precision, recall, f1 (3 decimals), missing, extra. Nothing expected and nothing found: all 1."""
    a, b = F.array_distinct(found), F.array_distinct(expected)
    out = df.withColumns({"tp": F.size(F.array_intersect(a, b)).cast("long"), "fp": F.size(F.array_except(a, b)).cast("long"), "fn": F.size(F.array_except(b, a)).cast("long")})
    out = out.withColumns({"missing": F.array_sort(F.array_except(b, a)), "extra": F.array_sort(F.array_except(a, b))})
    return out.withColumns(_prf(1.0))


def _prf(empty: float) -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda part, whole: F.when(whole == 0, F.when(tp + fp + fn == 0, F.lit(empty)).otherwise(F.lit(0.0))).otherwise(F.round(part / whole, 3))
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def micro(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Metrics of sums: nothing found is found right, nothing expected is missed by none."""
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in (tp, fp, fn))
    ratio = lambda part, whole: F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, 3))
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def micro_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tp, fp, fn and the metrics of the sums: a share of nothing is 1."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumns(micro(F.col("tp"), F.col("fp"), F.col("fn")))


def fuzzy_one_to_one(left: DataFrame, right: DataFrame, group: str, a: str, b: str, threshold: float = 0.9) -> DataFrame:
    """Pairs of values of a group with a token-sort ratio of at least threshold (over 2/3), taken from the most similar down (ties by
    value), each value once: group, a, b, ratio. Candidates meet by a gram of their sorted words; the greedy choice is made in rounds of
    pairs that are the best of both their values."""
    sorted_a, sorted_b = (df.select(group, c).where(F.col(c).isNotNull()).distinct().withColumn("__s", sorted_words(F.col(c))) for df, c in ((left, a), (right, b)))
    met = similar_candidates(sorted_a.withColumn("__x", F.col("__s")), sorted_b.withColumn("__y", F.col("__s")), group, "__x", "__y", threshold)
    scored = stored(met.withColumn("ratio", F.round(indel_ratio("__x", "__y"), 6)).where(F.col("ratio") >= threshold), "similar")
    same = lambda x, y, c: F.col(f"{x}.{group}").eqNullSafe(F.col(f"{y}.{group}")) & (F.col(f"{x}.{c}") == F.col(f"{y}.__s"))
    pairs = scored.alias("m").join(sorted_a.alias("l"), same("m", "l", "__x")).join(sorted_b.alias("r"), same("m", "r", "__y")).select(f"m.{group}", f"l.{a}", f"r.{b}", "ratio")
    return dominant_pairs(pairs, [group, a], [group, b], F.struct((-F.col("ratio")).alias("o"), b), F.struct((-F.col("ratio")).alias("o"), a))


def plain_text(c: Column) -> Column:
    """Lower case, no accents, single blanks; null gives an empty text."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "))


def match_rows(found: DataFrame, golden: DataFrame, doc: str, number: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """golden and found rows with a number of their own (__id), and the pairs (__g, __f) of a one-to-one match. Golden rows choose in the
    order of number (nulls last) and name, each the first found row that is left, in the same order: one of its number, else one whose
    name, plain, equals, holds or lies in its own. Rounds of dominant pairs give what choosing one after the other gives."""
    sides = []
    for df in (golden, found):
        own = df.withColumns({"__id": F.monotonically_increasing_id(), "__plain": plain_text(F.col(name))})
        sides.append(stored(own, "match-rows"))
    place = lambda: F.struct(F.col(number).isNull().alias("a"), F.col(number).alias("b"), F.col(name).alias("c"), F.col("__id").alias("d"))
    g, f = (s.select(F.col(doc).alias("__doc"), F.col(number).alias("__no"), "__plain", "__id", place().alias("__place")) for s in sides)
    same = F.col("g.__doc").eqNullSafe(F.col("f.__doc"))
    keep = [F.col("g.__id").alias("__g"), F.col("f.__id").alias("__f"), F.col("g.__place").alias("__gp"), F.col("f.__place").alias("__fp")]
    by_number = g.alias("g").join(shuffled(f).alias("f"), same & (F.col("g.__no") == F.col("f.__no"))).select(*keep, F.lit(1).alias("__stage"))
    by_name = g.alias("g").join(shuffled(f).alias("f"), same & (F.col("g.__plain") == F.col("f.__plain"))).select(*keep, F.lit(2).alias("__stage"))
    inner = contained_texts(g, f, "__doc", "__plain").select("__doc", F.col("needle").alias("__gt"), F.col("hay").alias("__ft"))
    outer = contained_texts(f, g, "__doc", "__plain").select("__doc", F.col("hay").alias("__gt"), F.col("needle").alias("__ft"))
    texts = inner.unionByName(outer).where("__gt <> __ft").distinct()
    via = g.alias("g").join(shuffled(texts).alias("t"), F.col("g.__doc").eqNullSafe(F.col("t.__doc")) & (F.col("g.__plain") == F.col("t.__gt"))).select("g.*", "__ft")
    by_part = via.alias("g").join(shuffled(f).alias("f"), same & (F.col("g.__ft") == F.col("f.__plain"))).select(*keep, F.lit(2).alias("__stage"))
    edges = by_number.unionByName(by_name).unionByName(by_part).groupBy("__g", "__f", "__gp", "__fp").agg(F.min("__stage").alias("__stage"))
    pairs = dominant_pairs(edges, ["__g"], ["__f"], F.struct("__stage", "__fp"), F.col("__gp"))
    return sides[0], sides[1], pairs.select("__g", "__f")


def match_golden(found: DataFrame, golden: DataFrame, doc: str, number: str, name: str) -> DataFrame:
    """doc, golden_name, found_name, status (matched, missing, hallucinated): each golden and each found row once, as match_rows pairs them."""
    g, f, pairs = match_rows(found, golden, doc, number, name)
    g = g.select(doc, F.col("__id").alias("__g"), F.col(name).alias("golden_name"))
    f = f.select(F.col(doc).alias("__doc"), F.col("__id").alias("__f"), F.col(name).alias("found_name"))
    both = g.join(pairs, "__g", "left").join(f, "__f", "full")
    status = F.when(F.col("__g").isNull(), "hallucinated").when(F.col("__f").isNull(), "missing").otherwise("matched")
    return both.select(F.when(F.col("__g").isNull(), F.col("__doc")).otherwise(F.col(doc)).alias(doc), "golden_name", "found_name", status.alias("status"))


def compare_rows(found: DataFrame, golden: DataFrame, doc: str, number: str, name: str) -> DataFrame:
    """Both tables: doc, number, name, titles, roles (arrays), months, work. One row for each golden and each found row: doc, number,
    golden_name, found_name, status, and of matched rows tp, fp, fn, precision, recall, f1 of titles and of roles, months_ok, work_ok (plain texts
    equal, or one in the other)."""
    g, f, pairs = match_rows(found, golden, doc, number, name)
    fields = ("titles", "roles", "months", "work")
    g = g.select(doc, number, F.col("__id").alias("__g"), F.col(name).alias("golden_name"), *(F.col(c).alias(f"__g_{c}") for c in fields))
    f = f.select(F.col(doc).alias("__doc"), F.col(number).alias("__no"), F.col("__id").alias("__f"), F.col(name).alias("found_name"), *(F.col(c).alias(f"__f_{c}") for c in fields))
    out = g.join(pairs, "__g", "left").join(f, "__f", "full")
    alone = F.col("__g").isNull()
    out = out.withColumns({doc: F.when(alone, F.col("__doc")).otherwise(F.col(doc)), number: F.when(alone, F.col("__no")).otherwise(F.col(number))})
    status = F.when(alone, "hallucinated").when(F.col("__f").isNull(), "missing").otherwise("matched")
    out = out.withColumn("status", status)
    matched = F.col("status") == "matched"
    plain = lambda c: F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), plain_text))
    names = []
    for field in ("titles", "roles"):
        out = set_metrics(out.withColumns({"__x": plain(F.col(f"__f_{field}")), "__y": plain(F.col(f"__g_{field}"))}), "__x", "__y")
        for c in ("tp", "fp", "fn", "precision", "recall", "f1"):
            out = out.withColumn(f"{field}_{c}", F.when(matched, F.col(c)))
            names.append(f"{field}_{c}")
        out = out.drop("__x", "__y", "tp", "fp", "fn", "precision", "recall", "f1", "missing", "extra")
    x, y = plain_text(F.col("__f_work")), plain_text(F.col("__g_work"))
    out = out.withColumn("months_ok", F.when(matched, F.col("__f_months").eqNullSafe(F.col("__g_months"))))
    out = out.withColumn("work_ok", F.when(matched, (x == y) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))))
    return out.select(doc, number, "golden_name", "found_name", "status", *names, "months_ok", "work_ok")


def golden_summary(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Of compare_rows, per keys: expected, extracted, matched, missing, hallucinated, micro metrics of titles and roles over matched rows, and the
    shares of matched rows with the same months and work (0 without any)."""
    status = F.col("status")
    matched = F.count_if(status == "matched")
    sums = [F.sum(f"{field}_{c}").alias(f"__{field}_{c}") for field in ("titles", "roles") for c in ("tp", "fp", "fn")]
    share = lambda c: F.when(matched > 0, F.round(F.count_if(F.col(c)) / matched, 3)).otherwise(F.lit(0.0))
    out = compared.groupBy(*keys).agg(
        F.count_if(status != "hallucinated").alias("expected"), F.count_if(status != "missing").alias("extracted"), matched.alias("matched"), F.count_if(status == "missing").alias("missing"),
        F.count_if(status == "hallucinated").alias("hallucinated"), share("months_ok").alias("months_share"), share("work_ok").alias("work_share"), *sums,
    )
    for field in ("titles", "roles"):
        out = out.withColumns({f"{field}_{k}": v for k, v in micro(*(F.col(f"__{field}_{c}") for c in ("tp", "fp", "fn"))).items()})
    return out.drop(*(f"__{field}_{c}" for field in ("titles", "roles") for c in ("tp", "fp", "fn")))
