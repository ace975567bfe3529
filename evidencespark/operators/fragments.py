"""Values checked against their source text, factors for roles, tables put back into pages, previews of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import near, token_set
from ..functions.similarity import word_overlap
from ..functions.text import normalize_role, strip_accents
from ..shared import shuffled

WORD_RATIO, WORD_SHARE, SET_RATIO = 92.0, 0.75, 80.0
NEAR_LETTERS = 7  # below, a word with a letter amiss is under WORD_RATIO
ROLE_SET_RATIO = 75.0
ROLE_OVERLAP, GENERIC_OVERLAP = 0.6, 0.5
METHOD_CHARS = 300


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"\s+", " "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _close_values(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, texts in pairs:
        out = []
        for own, text in zip(values, texts):
            kept = []
            for v in own:
                long = [w for w in v.split() if len(w) >= 4]
                enough = max(1, int(len(long) * WORD_SHARE))
                if long and sum(near(w, text, WORD_RATIO, NEAR_LETTERS) for w in long) >= enough and token_set(v, text) >= SET_RATIO:
                    kept.append(v)
            out.append(kept)
        yield pd.Series(out)


def drop_unsupported_values(df: DataFrame, values: str, text: str) -> DataFrame:
    """df with values kept where the text holds them, as a substring or by most of their long words with small misspellings; the others in
    <values>_rejected. Null and short (under 3 characters) values are rejected; a blank text supports everything; null values stay null."""
    source = _plain(F.col(text))
    far = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array()), _plain), lambda v: (F.length(v) >= 3) & ~F.contains(source, v)))
    out = df.withColumns({"__source": source, "__far": far}).withColumn("__close", _close_values("__far", "__source"))

    def holds(v: Column) -> Column:
        p = _plain(v)
        return (F.col("__source") == "") | ((F.length(p) >= 3) & (F.contains(F.col("__source"), p) | F.array_contains("__close", p)))

    return out.withColumns({values: F.filter(values, holds), f"{values}_rejected": F.filter(values, lambda v: ~holds(v))}).drop("__source", "__far", "__close")


# Long words that say nothing of a role.
PLAIN_WORDS = ("para", "como", "segun")


@F.pandas_udf(T.DoubleType())
def _set_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([None if a is None else token_set(a, b) for a, b in zip(left, right)], dtype="float64")


def _letters_only(c: Column) -> Column:
    return F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " ")


def flag_unsupported_values(df: DataFrame, value: str, text: str) -> DataFrame:
    """df with unsupported: true where the text does not hold the value: not as it is, and either words of four letters or more are missing
    (of three or more words, two) or the ratio of word sets is below ROLE_SET_RATIO. Blank values and texts are no sign. Only values left
    open by what the engine compares itself go, with their texts, to Python."""
    own, source = F.btrim(_letters_only(F.col(value)), F.lit(" \t\n\r")), _letters_only(F.col(text))
    out = df.withColumns({"__own": own, "__source": source})
    long = F.filter(F.split("__own", r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(*PLAIN_WORDS))
    missing = F.size(F.filter(long, lambda w: ~F.contains(F.col("__source"), w)))
    enough = (F.size(long) == 0) | (missing <= F.when(F.size(long) >= 3, 1).otherwise(0))
    held = (F.col("__own") == "") | (F.coalesce(F.col(text), F.lit("")) == "") | F.contains("__source", F.col("__own"))
    out = out.withColumns({"__held": held, "__enough": enough})
    open_ = ~F.col("__held") & F.col("__enough")
    ratio = _set_ratio(F.when(open_, F.col("__own")), F.when(open_, F.col("__source")))
    out = out.withColumn("__ratio", ratio)
    return out.withColumn("unsupported", ~F.col("__held") & ~(F.col("__enough") & (F.coalesce("__ratio", F.lit(0.0)) >= ROLE_SET_RATIO))).drop("__own", "__source", "__held", "__enough", "__ratio")


def attach_factors(rows: DataFrame, factors: DataFrame, doc: str, role: str, own: str) -> DataFrame:
    """rows (doc, role, own) with own filled, where null, by the first factor (doc, position, factor_role, method, points) whose role equals,
    contains or lies in the row's, or shares ROLE_OVERLAP of its words; rows still without one get the document's first factor that
    was used for no row and shares less than GENERIC_OVERLAP with every role. Roles meet factors as distinct texts of a document."""
    given = F.when(F.length(F.coalesce("method", F.lit(""))) > 0, F.left("method", F.lit(METHOD_CHARS))).when(F.col("points") > 0, F.concat(F.lit("Hasta "), F.col("points").cast("string"), F.lit(" puntos"))).otherwise("Sí evalúa")
    f = factors.where("factor_role is not null").select(doc, "position", normalize_role(F.col("factor_role")).alias("__f"), given.alias("__given"))
    tagged = rows.withColumn("__role", normalize_role(F.col(role)))
    roles = tagged.groupBy(doc, "__role").agg(F.max(F.col(own).isNull()).alias("__open"))
    pairs = roles.join(shuffled(f), doc).withColumn("__o", word_overlap(F.col("__role"), F.col("__f")))
    pairs = pairs.withColumn("__hit", F.coalesce(F.contains("__role", F.col("__f")) | F.contains(F.col("__f"), F.col("__role")) | (F.col("__o") >= ROLE_OVERLAP), F.lit(False)))
    order = Window.partitionBy(doc, "__role").orderBy("position", "__given")
    first = pairs.where("__hit").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    used = first.where("__open").select(doc, "position").distinct()
    generic = pairs.groupBy(doc, "position").agg(F.max("__o").alias("__most"), F.min("__given").alias("__given")).where(F.col("__most") < GENERIC_OVERLAP).join(shuffled(used), [doc, "position"], "left_anti")
    generic = generic.groupBy(doc).agg(F.min_by("__given", "position").alias("__generic"))
    out = tagged.join(shuffled(first.select(doc, "__role", F.col("__given").alias("__specific"))), [doc, "__role"], "left").join(shuffled(generic), doc, "left")
    return out.withColumn(own, F.coalesce(own, "__specific", "__generic")).select(*rows.columns)


def pair_chunks(left: DataFrame, right: DataFrame, doc: str, role: str, chunk: str) -> DataFrame:
    """left with the chunk of the same canonical role of right put after its own (the least, if there are several); rows without one stay."""
    other = right.groupBy(doc, normalize_role(F.col(role)).alias("__role")).agg(F.min(chunk).alias("__other"))
    both = left.withColumn("__role", normalize_role(F.col(role))).join(other, [doc, "__role"], "left")
    return both.withColumn(chunk, F.concat_ws("\n\n", chunk, "__other")).select(*left.columns)


def replace_table_zone(text: Column, table: Column, window: int = 5, short: int = 40) -> Column:
    """The text with its first run of mostly short lines replaced by table; table alone where there are under window lines or no such run."""
    lines = F.split(text, "\n")

    def in_zone(_: Column, i: Column) -> Column:
        filled = F.filter(F.slice(lines, i + 1, window), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
        return F.size(F.filter(filled, lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) < short)) > 0.6 * F.greatest(F.size(filled), F.lit(1))

    flags = F.transform(lines, in_zone)
    n = F.size(lines)
    begin = F.array_position(flags, True).cast("int")
    run = F.array_position(F.slice(flags, begin + 1, n), False).cast("int")
    after = F.when(run > 0, begin + run).otherwise(n + 1)
    part = lambda first, count: F.nullif(F.btrim(F.array_join(F.slice(lines, first, count), "\n"), F.lit(" \t\r\n")), F.lit(""))
    whole = F.concat_ws("\n\n", part(F.lit(1), F.greatest(begin - 1, F.lit(0))), table, part(after, n))
    return F.when((n < window) | (begin == 0), table).otherwise(whole)


def fuse_table_fragments(fragments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """One table of its fragments in order: all lines of the first, the data lines (no rule below a heading) of the rest."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    data = lambda t: F.filter(F.split(t, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|[\s:|-]+$"))
    fused = F.flatten(F.transform(ordered, lambda x, i: F.when(i == 0, F.split(x["t"], "\n")).otherwise(data(x["t"]))))
    return fragments.groupBy(*keys).agg(F.array_join(fused, "\n").alias(text), F.count(F.lit(1)).alias("fragments"))


def block_preview(text: Column, is_table: Column, most: int = 2000, head: int = 1000, tail: int = 500) -> Column:
    """Tables and short texts whole, of others the beginning and the end."""
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n[...]\n"), F.right(text, F.lit(tail)))
    return F.when(is_table | (F.length(text) <= most), text).otherwise(cut)
