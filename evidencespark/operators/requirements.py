"""Rows of requirements: titles and roles put where they belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio
from ..functions.text import TITLE_PREFIXES, distinct_ignoring_case, strip_accents, synonym_form, words

# Words that mark a role, phrases that fill a cell, and the prefix of roles that stand for a row number.
ROLE_WORDS = ("especialista", "jefe", "gerente", "residente", "supervisor", "coordinador", "director", "asistente", "inspector", "encargado", "responsable")
FILLER = r"(?i)la combinaci[oó]n|en la supervisi[oó]n|en la ejecuci[oó]n"
UNNAMED = "FILA_"
ROLE_RATIO = 50.0


def is_title(c: Column) -> Column:
    return F.lower(strip_accents(c)).rlike("^(?:" + "|".join(TITLE_PREFIXES) + ")")


def is_role(c: Column) -> Column:
    return F.lower(c).rlike("|".join(ROLE_WORDS))


def _trimmed(items: Column, least: int) -> Column:
    """Items without white space and punctuation around them, of at least so many characters."""
    cut = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.btrim(F.btrim(x), F.lit(",.;:-")))
    return F.filter(cut, lambda x: F.length(x) >= least)


def validate_requirement_rows(rows: DataFrame, titles: str, roles: str, role: str, expected: str) -> DataFrame:
    """rows with only titles in titles; roles found there are moved to roles, from which filler phrases and bare titles of one or two words
    go; a role unlike the one expected of the row gives way to that. Values differing in case only are one; null lists become empty."""
    rows = rows.withColumn("__given", _trimmed(F.col(titles), 4))
    moved = F.filter("__given", lambda x: ~is_title(x) & is_role(x))
    kept = F.filter(_trimmed(F.concat(F.coalesce(roles, F.array().cast("array<string>")), moved), 5), lambda x: ~x.rlike(FILLER) & ~(is_title(x) & ~is_role(x) & (F.size(words(x)) <= 2)))
    out = rows.withColumns({"__role": synonym_form(F.col(role)), "__expected": synonym_form(F.col(expected))})
    known = (F.col("__role") != "") & (F.col("__expected") != "") & ~F.startswith(F.col(expected), F.lit(UNNAMED))
    unlike = F.coalesce(known & (partial_ratio("__expected", "__role") < ROLE_RATIO), F.lit(False))
    out = out.withColumns({titles: distinct_ignoring_case(F.filter("__given", is_title)), roles: distinct_ignoring_case(kept), "__unlike": unlike})
    return out.withColumn(role, F.when(F.col("__unlike"), F.upper(F.trim(expected))).otherwise(F.col(role))).drop("__role", "__expected", "__unlike", "__given")
