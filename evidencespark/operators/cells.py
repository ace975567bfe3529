"""Tables as matrices of cells: rows of a table, columns found by its header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of the number column, and what the other columns' headers hold, the first that fits.
NUMBER_HEADERS = ("N°", "N", "NRO", "NUM", "")
TITLE_COLUMNS = {"role": ("CARGO|RESPONSABILIDAD", 1), "education": ("FORMACION|FORMACIÓN|ACADEMICA|ACADÉMICA", 2)}
EXPERIENCE_COLUMNS = {"role": ("CARGO|ROL", 1), "time": ("TIEMPO|EXPERIENCIA", 2), "works": ("TRABAJOS|PRESTACIONES|ACTIVIDAD", 3)}


def raw_tables(cells: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """Tables of two rows or more, cells trimmed, nulls empty."""
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").select(*keys)
    return cells.join(sizes, keys, "left_semi").withColumn(column, F.transform(column, lambda c: F.trim(F.coalesce(c, F.lit("")))))


def column_positions(header: Column, columns: dict[str, tuple[str, int]]) -> dict[str, Column]:
    """Places (from 0) of the number column, the first with its header, and of columns (name -> pattern, default), the last that fits and
    fits none before; defaults where none does."""
    upper = F.transform(header, lambda c: F.upper(F.trim(c)))
    kinds = F.transform(upper, lambda c: _kind(c, columns))
    out = {"number": F.coalesce(F.nullif(F.array_position(kinds, "number"), F.lit(0)) - 1, F.lit(0)).cast("int")}
    for name, (_, default) in columns.items():
        last = F.array_position(F.reverse(kinds), name)
        out[name] = F.when(last > 0, F.size(kinds) - last).otherwise(F.lit(default)).cast("int")
    return out


def _kind(cell: Column, columns: dict[str, tuple[str, int]]) -> Column:
    found = F.when(cell.isin(*NUMBER_HEADERS), F.lit("number"))
    for name, (pattern, _) in columns.items():
        found = found.when(cell.rlike(pattern), F.lit(name))
    return F.coalesce(found, F.lit(""))


def columns_by_header(tables: DataFrame, keys: list[str], row: str, column: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """keys, row, number and a text for each of columns: the cells of the rows below the header (the table's first row) at the places that it
    gives. Rows too short for them, or without a number of digits, go."""
    header = tables.groupBy(*keys).agg(F.min(row).alias("__first"), F.min_by(column, row).alias("__header"))
    header = header.select(*keys, "__first", *(c.alias(f"__p_{n}") for n, c in column_positions(F.col("__header"), columns).items()))
    body = tables.join(header, keys).where(F.col(row) > F.col("__first"))
    body = body.where(F.size(column) > F.greatest(*(F.col(f"__p_{n}") for n in ("number", *columns))))
    cell = lambda n: F.get(column, F.col(f"__p_{n}"))
    body = body.where(cell("number").rlike(r"^\d+$"))
    return body.select(*keys, row, cell("number").try_cast("long").alias("number"), *(cell(n).alias(n) for n in columns)).where("number is not null")


def title_rows(tables: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """keys, number, role, education of tables of titles: of repeated numbers the first role and the first education given."""
    rows = columns_by_header(tables, keys, row, column, TITLE_COLUMNS).where("role <> ''")
    given = F.when(F.col("education") != "", F.col(row))
    return rows.groupBy(*keys, "number").agg(F.min_by("role", row).alias("role"), F.coalesce(F.min_by("education", given), F.lit("")).alias("education"))


def experience_rows(tables: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """keys, number, role, time, works of tables of experience: the last row of a repeated number."""
    rows = columns_by_header(tables, keys, row, column, EXPERIENCE_COLUMNS)
    last = F.row_number().over(Window.partitionBy(*keys, "number").orderBy(F.desc(row)))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n", row)
