"""Markdown tables in pages: their quality, rows left out, section indexes; the text of a section that a reader gets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import bound
from .pages import EXCLUDE, INCLUDE, MIN_KEPT_CHARS, MIN_PAGE_CHARS, page_class

BLANK = " \t\n\x0b\x0c\r"
LARGE_PAGE, LARGE_CELL, FEW_CELLS, FEW_LINES = 4000, 800, 3, 3
TABLE_SCORE = 0.5
EVIDENCE_CHARS = 40_000


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def drop_wide_rows(text: Column, page: int = LARGE_PAGE, cell: int = LARGE_CELL, cells: int = FEW_CELLS) -> Column:
    """In pages of over page characters with three table lines or more: without the table lines that have a cell of over cell characters and at
    most cells filled ones (rules of dashes and colons count as none)."""

    def kept(line: Column) -> Column:
        own = F.transform(F.split(line, r"\|"), _trim)
        filled = F.size(F.filter(own, lambda c: (c != "") & ~F.replace(c, F.lit(" "), F.lit("")).rlike("^[-:]*$")))
        return ~(_trim(line).startswith("|") & (F.array_max(F.transform(own, F.length)) > cell) & (filled <= cells))

    def cut(lines: Column) -> Column:
        tables = F.size(F.filter(lines, lambda x: _trim(x).startswith("|")))
        return F.when(tables >= FEW_LINES, F.array_join(F.filter(lines, kept), "\n"))

    return F.when(F.length(text) <= page, text).otherwise(F.coalesce(bound(F.split(text, "\n"), cut), text))


def table_quality(text: Column, least: float = TABLE_SCORE) -> Column:
    """struct(valid, score, rows, columns, reason) of a markdown table: rows and columns there are, how far rows differ in columns, a rule below
    the header, the length of cells. reason: ok, score, or what makes it none: no table, rows, columns, uneven, short."""
    lines = F.filter(F.transform(F.split(_trim(F.coalesce(text, F.lit(""))), "\n"), _trim), lambda x: F.contains(x, F.lit("|")))
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    measured = lambda own: F.struct(
        F.size(own).alias("n"), F.transform(own, bars).alias("bars"), F.transform(F.filter(own, lambda x: ~F.contains(x, F.lit("---"))), bars).alias("data"),
        F.exists(own, lambda x: F.contains(x, F.lit("---"))).alias("rule"),
        F.filter(F.flatten(F.transform(F.filter(own, lambda x: ~F.contains(x, F.lit("---"))), lambda x: F.transform(F.split(x, r"\|"), _trim))), lambda c: c != "").alias("cells"),
    )

    def judged(m: Column) -> Column:
        counts = F.when(F.size(m["data"]) > 0, m["data"]).otherwise(m["bars"])
        spread, rows = F.array_max(counts) - F.array_min(counts), F.size(m["data"])
        columns = F.array_max(m["bars"]) - 1
        mean = F.aggregate(m["cells"], F.lit(0), lambda a, c: a + F.length(c)) / F.nullif(F.size(m["cells"]), F.lit(0))
        score = F.round(
            F.when(spread == 0, 0.35).when(spread == 1, 0.2).otherwise(0.0) + F.when(rows >= 10, 0.25).when(rows >= 5, 0.2).when(rows >= 3, 0.15).otherwise(0.05) + F.when(m["rule"], 0.15).otherwise(0.0)
            + F.when(mean.between(3, 200), 0.15).when(mean > 200, 0.05).otherwise(0.0) + 0.1, 2)
        out = lambda score, rows, columns, reason: F.struct(F.lit(reason == "ok").alias("valid"), score.cast("double").alias("score"), rows.cast("int").alias("rows"), columns.cast("int").alias("columns"), F.lit(reason).alias("reason"))
        return (
            F.when(m["n"] == 0, out(F.lit(0.0), F.lit(0), F.lit(0), "no table")).when(m["n"] < 3, out(F.lit(0.1), m["n"], F.lit(0), "rows")).when(columns < 3, out(F.lit(0.15), m["n"], columns, "columns"))
            .when(spread > F.when(rows >= 8, 5).otherwise(3), out(F.lit(0.1), m["n"], columns, "uneven")).when(F.length(text) / m["n"] < 4, out(F.lit(0.05), m["n"], columns, "short"))
            .when(score >= least, out(score, rows, columns, "ok")).otherwise(out(score, rows, columns, "score"))
        )

    return bound(bound(lines, measured), judged)


def section_index(indexes: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, section, ranges (array of structs first, last): rows of an index table, "| # | role | number | pages | ranges | first |" or, where no row
    of a document is one, "| # | role | pages | first | last |". Of repeated sections the last row holds."""
    lines = indexes.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")).where(_trim(F.col("line")).rlike(r"^\|.*\|$"))
    cells = F.transform(F.filter(F.split(_trim(F.col("line")), r"\|"), lambda x, i: i > 0), _trim)
    rows = lines.withColumn("c", cells).withColumn("section", F.get("c", 0).try_cast("int")).where("section is not null").withColumn("n", F.size("c") - 1)
    spans = F.transform(F.regexp_extract_all(F.get("c", 4), F.lit(r"\d+\s*[–-]\s*\d+"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("first"), F.regexp_extract(x, r"\d+$", 0).cast("int").alias("last")))
    old = F.struct(F.get("c", 3).try_cast("int").alias("first"), F.get("c", 4).try_cast("int").alias("last"))
    ranges = F.when(F.col("n") == 6, spans).when((F.col("n") == 5) & old["first"].isNotNull() & old["last"].isNotNull(), F.array(old))
    found = rows.select(doc, "section", "pos", (F.col("n") == 6).alias("wide"), ranges.alias("ranges")).where(F.size("ranges") > 0)
    found = found.withColumn("any_wide", F.max("wide").over(Window.partitionBy(doc))).where("wide or not any_wide")
    return found.groupBy(doc, "section").agg(F.max_by("ranges", "pos").alias("ranges"))


def number_runs(text: Column) -> Column:
    """How many lines that are a number of one or two digits are followed, as the next such line, by the number after it."""
    numbers = F.transform(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _trim), lambda x: x.rlike(r"^\d{1,2}$")), lambda x: x.cast("int"))
    return bound(numbers, lambda n: F.size(F.filter(n, lambda x, i: x == F.get(n, i - 1) + 1)))


def page_sets(blocks: DataFrame, doc: str, page: str) -> DataFrame:
    """The distinct pages of a document's selected blocks, in order."""
    return blocks.select(doc, page).distinct().groupBy(doc).agg(F.array_sort(F.collect_list(page)).alias("pages"))


def sort_blocks(blocks: DataFrame, doc: str, first: str) -> DataFrame:
    """Blocks with place, by their first page (and block)."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(first, "block")))


def evidence_texts(pages: DataFrame, keys: list[str], block: str, page: str, most: int = EVIDENCE_CHARS, include: str = INCLUDE, exclude: str = EXCLUDE, classes=None) -> DataFrame:
    """pages: keys (of a section), block (from 0), page, text. keys, kind (person, experiences), text: what a reader of a section gets for either. Of
    several blocks the second for the person; the third, or the second of two, for experiences: their useful pages. Of a single one pages by
    class: for the person declarations and then diplomas, for experiences certificates, else declarations; its useful pages where there are none. Texts hold at
    most most characters, and no page beyond them is gathered."""
    own = pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("class", page_class(F.col("text"), classes) if classes else page_class(F.col("text")))
    useful = (F.length("text") < MIN_PAGE_CHARS) | F.col("text").rlike(include) | ~F.col("text").rlike(exclude)
    section, part = Window.partitionBy(*keys), Window.partitionBy(*keys, block)
    own = own.withColumn("useful", useful)
    own = own.withColumns({
        "blocks": F.max(block).over(section) + 1, "kept": F.sum(F.when(F.col("useful"), F.length("text")).otherwise(0)).over(part),
        **{f"any_{c}": F.max(F.col("class") == c).over(section) for c in ("anexo16", "diplomas", "certificados")},
    })
    shown = F.col("useful") | (F.col("kept") < MIN_KEPT_CHARS)
    several = F.col("blocks") >= 2
    declared, diploma, certificate = ((F.coalesce(F.col("class") == c, F.lit(False))) for c in ("anexo16", "diplomas", "certificados"))
    any_of = lambda *c: reduce(lambda a, b: a | b, (F.coalesce(F.col(f"any_{x}"), F.lit(False)) for x in c))
    person = F.when(several, (F.col(block) == 1) & shown).otherwise(F.when(any_of("anexo16", "diplomas"), declared | diploma).otherwise(shown))
    chosen = F.when(F.col("blocks") >= 3, F.lit(2)).otherwise(F.lit(1))
    experience = F.when(several, (F.col(block) == chosen) & shown).otherwise(F.when(any_of("certificados"), certificate).when(any_of("anexo16"), declared).otherwise(shown))
    kinds = F.array_compact(F.array(F.when(person, F.struct(F.lit("person").alias("kind"), diploma.cast("int").alias("rank"))), F.when(experience, F.struct(F.lit("experiences").alias("kind"), F.lit(0).alias("rank")))))
    rows = own.select(*keys, page, "text", F.col("blocks"), F.explode(kinds).alias("k")).select(*keys, page, "text", "k.kind", F.when(F.col("blocks") >= 2, 0).otherwise(F.col("k.rank")).alias("rank"))
    order = Window.partitionBy(*keys, "kind").orderBy("rank", page)
    before = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = rows.withColumn("before", before).where(F.col("before") < most + 2)  # the blank line before a page counts as the texts' own
    texts = near.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(page).alias("page"), "text"))).alias("t"))
    return texts.select(*keys, "kind", F.left(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.lit(most)).alias("text"))
