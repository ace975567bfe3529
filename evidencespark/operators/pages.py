"""Pages of text: scores, types, blocks, filters, table signs, line segments, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import bound
from ..functions.text import strip_accents
from ..rules import MAX_PAGE_GAP, SIGNALS, TYPE_THRESHOLD
from ..shared import stored
from .chains import first_beyond, reachable, running_sums

# Patterns of useful, excluded and classified pages.
INCLUDE = r"(?i)CERTIFICA|CONSTANCIA|ha\s+prestado\s+servicios|ANEXO\s+N[°º]|identificado\s+con\s+documento|desempe[ñn][áa]ndose\s+como|Calificaciones\s+y\s+Experiencia|Formaci[óo]n\s+acad[ée]mica"
EXCLUDE = r"(?i)CL[ÁA]USULA|CONTRATO\s+N[°º.]|PENALIDAD|SE\s+RESUELVE|VALORIZACI[ÓO]N|CONSIDERANDO:|VISTO:|RECEPCI[ÓO]N\s+DE\s+LA\s+OBRA|PROGRAMA\s+DE\s+TRABAJOS|Bases\s+Integradas"
PAGE_CLASSES = (
    ("anexo16", r"(?i)ANEXO\s+N[°º]\s*16|CALIFICACIONES\s+Y\s+EXPERIENCIA|Formaci[óo]n\s+acad[ée]mica"),
    ("ruido", r"(?i)SUSALUD|IPRESS|RENIPRESS|SEACE|Buscador\s+de\s+Proveedores"),
    ("certificados", r"(?i)CONSTANCIA\s+DE\s+(?:SERVICIOS|TRABAJO|EJECUCI[ÓO]N)|CERTIFICA(?:DO|MOS)?\s+(?:DE\s+(?:TRABAJO|SERVICIOS)|QUE)|ha\s+(?:prestado|brindado)\s+(?:sus\s+)?servicios|DEJA\s+CONSTANCIA"),
    ("diplomas", r"(?i)A\s+NOMBRE\s+DE\s+LA\s+NACI[ÓO]N|T[ÍI]TULO\s+(?:PROFESIONAL|de\s+INGENIERO|de\s+ARQUITECTO)|EL\s+(?:RECTOR|DECANO)"),
)
MIN_PAGE_CHARS, MIN_KEPT_CHARS = 200, 100


def score_pages(pages: DataFrame, signals: dict = SIGNALS) -> DataFrame:
    """pages (text) with score_<class>: the sum of the weights of the patterns found in the page, rounded to 2."""
    plain = strip_accents(F.lower(F.coalesce("text", F.lit(""))))
    pages = pages.withColumn("__plain", plain)
    sums = {f"score_{k}": F.round(sum((F.when(F.col("__plain").rlike(p), w).otherwise(0.0) for p, w in rules), F.lit(0.0)), 2) for k, rules in signals.items()}
    return pages.withColumns(sums).drop("__plain")


def dominant_type(classes: list[str], blacklist: str | None = "blacklist", threshold: float = TYPE_THRESHOLD) -> Column:
    """The class of the highest score; null if that is below threshold or not above the blacklist's. Ties go to the first."""
    own = [c for c in classes if c != blacklist]
    best = F.greatest(*(F.col(f"score_{c}") for c in own), F.lit(0.0))
    out = F.lit(None).cast("string")
    for c in reversed(own):
        out = F.when(F.col(f"score_{c}") == best, F.lit(c)).otherwise(out)
    black = F.col(f"score_{blacklist}") if blacklist else F.lit(-1.0)
    return F.when((best >= threshold) & (black < best), out)


def group_pages_into_blocks(pages: DataFrame, doc: str, page: str, kind: str, gap: int = MAX_PAGE_GAP) -> DataFrame:
    """Typed pages with block: a new one where the type changes or the page is more than gap after the last typed page."""
    order = Window.partitionBy(doc).orderBy(page)
    typed = pages.where(F.col(kind).isNotNull())
    new = (F.col(kind) != F.lag(kind).over(order)) | (F.col(page) - F.lag(page).over(order) > gap) | F.lag(page).over(order).isNull()
    return typed.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


#: Page numbers of a bin: a range meets pages by the bins that it touches.
PAGE_BIN = 16


def attach_pages(ranges: DataFrame, pages: DataFrame, doc: str, page: str, first: str = "first", last: str = "last") -> DataFrame:
    """Pages of each range of pages, both ends in. Ranges are spread over the bins that they touch, not over their pages, for an equality
    join; a page lies in one bin, so each pair meets once. Ranges that end before they begin hold none."""
    bins = lambda c: F.floor(F.col(c).cast("long") / PAGE_BIN)
    spread = ranges.where(F.col(first) <= F.col(last)).withColumn("__bin", F.explode(F.sequence(bins(first), bins(last))))
    own = pages.withColumn(page, F.col(page).cast("long")).withColumn("__bin", bins(page))
    return spread.join(own, [doc, "__bin"]).where(F.col(page).between(F.col(first), F.col(last))).drop("__bin")


def attach_pages_to_sections(sections: DataFrame, pages: DataFrame, doc: str, page: str, section: str, separator: str = "separator", texts: DataFrame | None = None, page_id: str | None = None) -> DataFrame:
    """sections: doc, section, separator (its page, may be null), ranges (array of structs first, last). doc, section, texts (one for each range,
    its pages in order under their tags, pages that are not there left out), text (all of them). A range that begins at the separator page
    begins after it; ranges left without a page number go, and sections left without a range as well. pages: doc, page and text, or page_id by which
    texts (page_id, text) has the text: then only the texts of pages inside ranges are moved, after the ranges have found their pages."""
    ranges = F.transform("ranges", lambda r: F.struct((r["first"] + F.when(r["first"] == F.col(separator), 1).otherwise(0)).cast("long").alias("first"), r["last"].cast("long").alias("last")))
    kept = sections.select(doc, section, F.filter(ranges, lambda r: r["first"] <= r["last"]).alias("r")).where(F.size("r") > 0)
    spread = kept.select(doc, section, F.size("r").alias("n"), F.posexplode("r").alias("range", "r")).select(doc, section, "n", "range", "r.first", "r.last")
    own = "text" if texts is None else page_id
    met = attach_pages(spread, pages.select(doc, page, own), doc, page).select(doc, section, "n", "range", F.col(page).alias("p"), own)
    if texts is not None:
        met = met.join(texts.select(page_id, "text"), page_id)
    tagged = F.concat(F.lit("[Página "), F.col("p").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    one = met.select(doc, section, "n", F.struct("range", "p", tagged.alias("t")).alias("page"))
    none = kept.select(doc, section, F.size("r").alias("n"), F.lit(None).cast(one.schema["page"].dataType).alias("page"))
    grouped = one.unionByName(none).groupBy(doc, section).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("page")).alias("own"))
    joined = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda r: F.array_join(F.transform(F.filter("own", lambda x: x["range"] == r), lambda x: x["t"]), "\n\n"))
    return grouped.select(doc, section, joined.alias("texts")).withColumn("text", F.array_join("texts", "\n\n"))


def expand_block_context(blocks: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages from one before a block (doc, block, first, last) to one after it."""
    wider = blocks.withColumns({"first": F.greatest(F.lit(1), F.col("first") - 1), "last": F.col("last") + 1})
    return attach_pages(wider, pages, doc, page)


def block_text(block_pages: DataFrame, keys: list[str], page: str, text: str = "text") -> DataFrame:
    """The pages of a block in order, each under its tag, with the first and last page."""
    tagged = F.concat(F.lit("[Página "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), tagged.alias("t"))))
    return block_pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"), F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("pages"))


def filter_relevant_pages(pages: DataFrame, doc: str, include: str = INCLUDE, exclude: str = EXCLUDE) -> DataFrame:
    """Short pages and those with a useful mark stay, those with an excluding mark only go; a document of which fewer than
    MIN_KEPT_CHARS would be left stays whole."""
    keep = (F.length("text") < MIN_PAGE_CHARS) | F.col("text").rlike(include) | ~F.col("text").rlike(exclude)
    kept = F.sum(F.when(keep, F.length("text")).otherwise(0)).over(Window.partitionBy(doc))
    return pages.withColumns({"__keep": F.coalesce(keep, F.lit(False)), "__kept": kept}).where(F.col("__keep") | (F.col("__kept") < MIN_KEPT_CHARS)).drop("__keep", "__kept")


def page_class(text: Column, classes=PAGE_CLASSES) -> Column:
    """The first class whose pattern is found; ruido otherwise; null for pages too short to be one."""
    out = F.lit("ruido")
    for name, pattern in reversed(classes):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(F.length(F.trim(text)) >= MIN_PAGE_CHARS, out)


def table_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|"))


def is_table_page(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(table_lines(text)) >= 5) & (F.size(table_lines(text)) > 0.6 * F.size(filled))


def count_table_items(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*\|\s*\d+\s*\|"))


TABLE_HEADERS = r"(?U)\b(ítem|cant|cargo|formaci[oó]n|experiencia|puesto|denominaci[oó]n|t[ií]tulo profesional|grado)\b"


def table_likelihood(text: Column) -> Column:
    """0 to 1 by seven signs of a table: short lines, many short lines, repeats, "N meses en", titles, running numbers, header words. Lines and
    the lower-case text are made once for all signs."""

    def judged(m: Column) -> Column:
        lines, low, numbers = m["lines"], m["low"], m["numbers"]
        n = F.size(lines)
        short = F.size(F.filter(lines, lambda x: F.length(x) < 30)) / n
        mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
        repeats = bound(F.filter(F.transform(lines, F.lower), lambda x: F.length(x) > 15), lambda p: F.size(p) - F.size(F.array_distinct(p)))
        titles = F.regexp_count(low, F.lit("ingeniero|bachiller|arquitecto"))
        running = F.size(F.filter(numbers, lambda x, i: x == F.get(numbers, i - 1) + 1))
        heads = F.size(F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(TABLE_HEADERS), F.lit(1)), strip_accents)))
        signs = [
            (short > 0.5, 0.15), ((mean < 40) & (n > 20), 0.15), (repeats >= 3, 0.15), (F.regexp_count(low, F.lit(r"\d+\s*meses\s+en")) >= 2, 0.2), (titles >= 3, 0.1),
            ((F.size(numbers) >= 3) & (running >= 2), 0.1), (heads >= 3, 0.15),
        ]
        score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in signs), F.lit(0.0))
        return F.when(n > 0, F.round(F.least(score, F.lit(1.0)), 2)).otherwise(F.lit(0.0))

    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    made = bound(lines, lambda own: F.struct(own.alias("lines"), F.lower(text).alias("low"), F.transform(F.filter(own, lambda x: x.rlike(r"^\d{1,2}$")), lambda x: x.cast("int")).alias("numbers")))
    return F.when(F.length(F.trim(text)) >= 100, bound(made, judged)).otherwise(F.lit(0.0))


def group_consecutive(df: DataFrame, keys: list[str], number: str, most: int = 2) -> DataFrame:
    """Runs of consecutive numbers, cut to at most so many: keys, first, last, n."""
    order = Window.partitionBy(*keys).orderBy(number)
    runs = df.withColumn("__island", F.col(number) - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(number)) - 1
    return runs.withColumn("__part", F.floor(place / most)).groupBy(*keys, "__island", "__part").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("__island", "__part")


def segment_lines(lines: DataFrame, doc: str, line: str, anchor: str) -> DataFrame:
    """Lines with segment: the number of anchors (non-null) up to the line, 0 before the first."""
    order = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.count(anchor).over(order))


def suppress_repeated_anchors(anchors: DataFrame, doc: str, line: str, anchor: str, within: int = 3) -> DataFrame:
    """The first of each anchor of a document, repeats within so many lines dropped first."""
    near = Window.partitionBy(doc, anchor).orderBy(line)
    kept = anchors.withColumn("__last", F.lag(line).over(near)).where(F.col("__last").isNull() | (F.col(line) - F.col("__last") > within))
    return kept.withColumn("__n", F.row_number().over(near)).where("__n = 1").drop("__last", "__n")


def choose_anchors(named: DataFrame, numbered: DataFrame, doc: str, line: str, anchor: str, expected: str, most: float = 1.3, unknown: int = 25) -> DataFrame:
    """The anchors that cut a document: the first of each name, in order, up to most times the rows expected (unknown where none are);
    those by number instead where the names are fewer than three or half the rows expected and the numbers are more than they.
    Both tables: doc, line, anchor, expected. Counts are per document; null anchors count as none."""
    cap = F.when(F.col(expected) > 0, F.floor(F.col(expected) * most)).otherwise(unknown)
    columns = [doc, line, anchor, expected]
    first = suppress_repeated_anchors(named.where(F.col(anchor).isNotNull()).select(*columns), doc, line, anchor)
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy(line))).where(F.col("__n") <= cap).drop("__n")
    both = first.withColumn("__numbered", F.lit(False)).unionByName(numbered.where(F.col(anchor).isNotNull()).select(*columns).withColumn("__numbered", F.lit(True)))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(Window.partitionBy(doc))
    both = both.withColumns({"__names": count(~F.col("__numbered")), "__numbers": count(F.col("__numbered"))})
    few = F.col("__names") < F.greatest(F.lit(3), F.floor(F.coalesce(expected, F.lit(0)) / 2))
    return both.where(F.col("__numbered") == (few & (F.col("__numbers") > F.col("__names")))).select(*columns)


def section_page_spans(pages: DataFrame, spare: DataFrame, doc: str, page: str, heads: tuple[str, str, str], end: str) -> DataFrame:
    """doc, section (1 or 2), page. A section runs from the first page with its heading to the next heading; the second one, where no third
    heading follows, through the first later page with the end mark. Of documents with neither heading the spare pages (doc, page) are
    halved; a lone one is in both halves. Marks are found before the shuffle, so that no text is moved."""
    found = {f"__h{i}": F.coalesce(F.col("text").rlike(p), F.lit(False)) for i, p in enumerate((*heads, end), 1)}
    marks = pages.withColumns(found).select(doc, page, *found)
    own = Window.partitionBy(doc)
    first = lambda c: F.min(F.when(c, F.col(page))).over(own)
    marks = marks.withColumns({f"__s{i}": first(F.col(f"__h{i}")) for i in (1, 2, 3)}).withColumn("__last", F.max(page).over(own))
    marks = marks.withColumn("__end", first(F.col("__h4") & (F.col(page) > F.col("__s2"))) + 1)
    inside = [
        (F.col(page) >= F.col("__s1")) & (F.col(page) < F.coalesce("__s2", "__s3", F.col("__last") + 1)),
        (F.col(page) >= F.col("__s2")) & (F.col(page) < F.coalesce("__s3", "__end", F.col("__last") + 1)),
    ]
    sections = F.array_compact(F.array(*(F.when(c, i) for i, c in enumerate(inside, 1))))
    headed = marks.select(doc, F.explode(sections).alias("section"), page)
    bare = marks.where("__s1 is null and __s2 is null").select(doc).distinct()
    halves = spare.join(bare, doc, "left_semi").withColumns({"__r": F.row_number().over(own.orderBy(page)), "__n": F.count(F.lit(1)).over(own)})
    half = F.floor(F.col("__n") / 2)
    both = F.array_compact(F.array(F.when((F.col("__r") <= half) | (F.col("__n") == 1), 1), F.when(F.col("__r") > half, 2)))
    return headed.unionByName(halves.select(doc, F.explode(both).alias("section"), page))


def block_diagnostics(block_pages: DataFrame, calls: DataFrame, keys: list[str], page: str, size: str) -> DataFrame:
    """Per block its pages with their sizes, and of its calls (keys, ok, items): how many, how many failed, the items they gave."""
    blocks = block_pages.groupBy(*keys).agg(
        F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("pages"), F.sum(size).alias("chars"),
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(size).alias("size")))).alias("sizes"),
    )
    made = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))
    return blocks.join(made, keys, "left").fillna(0, ["calls", "failed", "items"])


def first_page_matching(pages: DataFrame, doc: str, page: str, pattern: str) -> DataFrame:
    return pages.groupBy(doc).agg(F.min(F.when(F.col("text").rlike(pattern), F.col(page))).alias("first_page"))


def page_range_coverage(ranges: DataFrame, pages: DataFrame, keys: list[str], doc: str, page: str) -> DataFrame:
    """Per range of pages: how many there are among pages, in percent, and a light."""
    spread = ranges.withColumn(page, F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))))
    seen = pages.select(doc, F.col(page).cast("long").alias(page)).distinct().withColumn("__seen", F.lit(1))
    out = spread.join(seen, [doc, page], "left").groupBy(*keys).agg(F.count("__seen").alias("covered"), F.count(F.lit(1)).alias("pages"))
    pct = F.round(100 * F.col("covered") / F.col("pages"), 1)
    return out.withColumn("pct", pct).withColumn("light", F.when(F.col("pct") > 50, "green").when(F.col("pct") > 20, "yellow").otherwise("red"))


def text_density_route(pages: DataFrame, doc: str, page: str, sample: int = 5) -> DataFrame:
    """digital, scanned or mixed by the mean length of the first pages and of all."""
    own = F.length(F.trim(F.coalesce("text", F.lit(""))))
    first = F.avg(F.when(F.col("__n") <= sample, own))
    out = pages.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy(page))).groupBy(doc).agg(first.alias("first_mean"), F.avg(own).alias("mean"))
    return out.withColumn("route", F.when(F.col("first_mean") >= 200, "digital").when(F.col("mean") < 50, "scanned").otherwise("mixed"))


def pack_pages(pages: DataFrame, doc: str, page: str, most: int = 30_000, overlap: int = 1, table: Column | None = None, whole: Column | None = None, size: Column | None = None) -> DataFrame:
    """doc, part (from 1, by first page), page. Pages that hold a table are parts of their own. The others stay together if they hold at most
    most characters; else they are packed in order, each part as many pages as fit (at least one) and the next one beginning overlap pages
    before its end if it has more than these, so the last pages come again by themselves. Documents marked whole are one part. Parts are
    found by running sums, a successor for each page and pointer doubling; only lengths and marks are moved, no text (none is needed where size gives the lengths)."""
    marks = {"size": (F.length(F.coalesce("text", F.lit(""))) if size is None else size).cast("long"), "__table": F.coalesce(F.lit(False) if table is None else table, F.lit(False)), "__whole": F.coalesce(F.lit(False) if whole is None else whole, F.lit(False))}
    own = pages.withColumns(marks).select(F.struct(doc).alias("__d"), F.col(page).cast("long").alias("__p"), *marks)
    alone = own.where("__table and not __whole").select("__d", F.col("__p").alias("first"), F.lit(0).cast("long").alias("i"), F.lit(1).alias("alone"))
    rows = stored(running_sums(own.where("__whole or not __table"), "__d", "__p", "size"), "pages-placed")
    limit = first_beyond(rows, "__d", most)
    end = F.greatest(F.coalesce("beyond", "rows_in_key"), F.col("i") + 1)
    steps = rows.join(limit, ["__d", "i"]).withColumn("end", F.when(F.col("__whole") | (F.col("total") <= most), F.col("rows_in_key")).otherwise(end))
    to = F.when((F.col("total") > most) & ~F.col("__whole") & (F.col("end") - F.col("i") > overlap), F.col("end") - overlap).otherwise(F.col("end"))
    steps = stored(steps.withColumn("to", to).select("__d", "i", F.col("__p").alias("first"), "end", "to", "rows_in_key"), "pages-steps")
    starts = reachable(steps.where("to < rows_in_key"), "__d").unionByName(steps.where("to >= rows_in_key and i = 0").select("__d", "i")).distinct()
    parts = starts.join(steps, ["__d", "i"]).select("__d", "first", "i", F.lit(0).alias("alone"), "end")
    parts = parts.unionByName(alone.withColumn("end", F.lit(1).cast("long")))
    parts = stored(parts.withColumn("part", F.row_number().over(Window.partitionBy("__d").orderBy("first", "i", "alone")).cast("long")), "pages-parts")
    spread = parts.where("alone = 0").withColumn("i", F.explode(F.sequence("i", F.col("end") - 1)))
    packed = spread.join(rows.select("__d", "i", "__p"), ["__d", "i"]).select("__d", "part", F.col("__p").alias(page))
    single = parts.where("alone = 1").select("__d", "part", F.col("first").alias(page))
    return packed.unionByName(single).select(F.col("__d")[doc].alias(doc), "part", page)
