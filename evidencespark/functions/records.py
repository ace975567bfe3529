"""Semi-structured records: numbers in text, renamed keys, model answers as JSON, null words."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_float(c: Column) -> Column:
    """A number with thousands commas; blank and bad text are null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def leading_int(c: Column) -> Column:
    """The first whole number of a text of at most 30 characters."""
    return F.when(F.length(c) <= 30, F.regexp_extract(c, r"(\d+)", 1).try_cast("int"))


def null_words_to_null(df: DataFrame) -> DataFrame:
    """"null", "none" and blank become null in all text columns and, at any depth, in structs and arrays of text."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(~F.lower(F.trim(c)).isin("null", "none", ""), c)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def rename_keys(record: Column, synonyms: dict[str, str]) -> Column:
    """A map<string,string> with its keys in canonical form; of several values of a key the last wins."""
    names = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
    entries = F.transform(F.map_entries(record), lambda e: F.struct(F.coalesce(names[F.lower(F.trim(e["key"]))], F.lower(F.trim(e["key"]))).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def clean_model_json(c: Column) -> Column:
    """The JSON text of a model's answer: think block, code fence and words around it removed."""
    text = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_replace(text, "`", ""))
    return F.trim(F.regexp_extract(body, r"(?s)([\[{].*)$", 1))


def repair_json(c: Column) -> Column:
    """Missing and trailing commas, and brackets left open at the end."""
    text = F.regexp_replace(c, r"([}\]\"0-9])(\s*\n\s*)(?=[\"{\[])", "$1,$2")
    text = F.regexp_replace(text, r",\s*(?=[}\]])", "")
    text = F.regexp_replace(text, r",\s*$", "")
    opened = lambda a, b: F.greatest(F.lit(0), F.regexp_count(text, F.lit(a)) - F.regexp_count(text, F.lit(b)))
    return F.concat(text, F.repeat(F.lit("]"), opened(r"\[", r"\]")), F.repeat(F.lit("}"), opened(r"\{", r"\}")))


def parse_model_json(df: DataFrame, column: str) -> DataFrame:
    """df with value (VARIANT) and outcome: parsed, repaired or failed."""
    clean = clean_model_json(F.col(column))
    first = F.try_parse_json(F.nullif(clean, F.lit("")))
    second = F.try_parse_json(F.nullif(repair_json(clean), F.lit("")))
    outcome = F.when(first.isNotNull(), "parsed").when(second.isNotNull(), "repaired").otherwise("failed")
    return df.withColumns({"value": F.coalesce(first, second), "outcome": outcome})


def drop_sparse_rows(df: DataFrame, columns: list[str], limit: float = 0.8) -> DataFrame:
    """Rows of which the share of null columns (empty arrays count as null) is below limit."""
    kinds = dict(df.dtypes)
    empty = [F.when(F.col(c).isNull() | ((F.size(c) == 0) if kinds[c].startswith("array") else F.lit(False)), 1).otherwise(0) for c in columns]
    return df.where(sum(empty, F.lit(0)) / len(columns) < limit) if columns else df.limit(0)


def flag_suspicious_id(df: DataFrame, column: str, digits: int = 7) -> DataFrame:
    """Numbers of so many digits or more can't be registrations: moved to <column>_raw, nulled, marked for review."""
    odd = F.coalesce(F.length(F.regexp_replace(column, r"\D", "")) >= digits, F.lit(False))
    return df.withColumns({f"{column}_raw": F.when(odd, F.col(column)), "needs_review": odd, column: F.when(~odd, F.col(column))})


def cap_by(value: Column, limit: Column) -> Column:
    return F.when(value > limit, limit).otherwise(value)


def clean_duration(c: Column) -> Column:
    """Placeholder "N meses" is null; a legal note in brackets is cut."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*(?:emisi|contabiliz|grado|t[ií]tulo)[^)]*\)", ""), r"(?i)^t[ií]tulo profesional\s*[:,-]?\s*", ""))
    return F.when(~text.rlike(r"(?i)^N\s+meses$") & (text != ""), text)


# The keys under which records of a nested answer state their kind, and those of their cells.
KIND_KEYS = ("type", "label", "content_type", "doc_item_label")
DATA_KEYS, GRID_KEYS = ("data", "table_data"), ("grid", "table_cells", "cells")
NESTED = "array<struct<path:string,label:string,rows:int,columns:int>>"


def matrix_shape(grid: Column) -> Column:
    """Rows, and columns of the longest row, of an array of arrays."""
    return F.struct(F.greatest(F.size(grid), F.lit(0)).alias("rows"), F.coalesce(F.array_max(F.transform(grid, lambda r: F.greatest(F.size(r), F.lit(0)))), F.lit(0)).alias("columns"))


def cell_shape(cells: Column, row: str = "row", column: str = "col") -> Column:
    """Distinct row and column numbers of an array of cells."""
    count = lambda name: F.coalesce(F.size(F.array_distinct(F.transform(cells, lambda c: c[name]))), F.lit(0))
    return F.struct(F.greatest(count(row), F.lit(0)).alias("rows"), F.greatest(count(column), F.lit(0)).alias("columns"))


def _grid_shape(record: dict[str, Any]) -> tuple[int, int]:
    grids = (record[d][g] for d in DATA_KEYS if isinstance(record.get(d), dict) for g in GRID_KEYS if record[d].get(g) and isinstance(record[d][g], list))
    for grid in grids:
        if isinstance(grid[0], list):
            return len(grid), max(len(r) for r in grid if isinstance(r, list))
        cells = [c for c in grid if isinstance(c, dict)]
        if cells:
            return tuple(len({str(c.get(short, c.get(long, 0))) for c in cells}) for short, long in (("row", "row_index"), ("col", "col_index")))
    return 0, 0


def _nested(text: str | None, word: str, depth: int) -> list[tuple[str, str, int, int]]:
    try:
        todo, found = [("$", json.loads(text or "null"), 0)], []
    except ValueError:
        return []
    while todo:
        path, value, level = todo.pop()
        if isinstance(value, dict):
            label = next((value[k] for k in KIND_KEYS if isinstance(value.get(k), str) and word in value[k].lower()), None)
            if label is not None:
                found.append((path, label, *_grid_shape(value)))
        if level < depth:
            inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
            todo += reversed([(f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}", v, level + 1) for k, v in inner if isinstance(v, (dict, list))])
    return found


def find_nested_records(df: DataFrame, column: str, word: str = "table", depth: int = 10) -> DataFrame:
    """A row for each record, at most depth levels down in the JSON text of column, whose kind holds word: df's columns without column, path,
    label, rows, columns of its grid. Null, bad and other JSON gives no rows."""

    @F.pandas_udf(NESTED)
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_nested(t, word, depth) for t in texts])

    return df.withColumn("__found", F.explode(walk(column))).select(*(c for c in df.columns if c != column), "__found.*")
