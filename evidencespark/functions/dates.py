"""Dates written in several ways, and day counts between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import COVID, MONTHS


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A date, or null for what is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    """1 to 12 for a Spanish month name or its short form, else null."""
    pairs = [F.lit(x) for k, v in MONTHS.items() for x in (k, str(v))]
    return F.create_map(*pairs)[F.lower(name)]


def parse_spanish_date(c: Column) -> Column:
    """Four ways of writing in turn: 10 de enero del 2023; 01/ENE/2018; 15/03/2020; 2023-01-15. Phrases like "a la fecha" are null."""
    t = F.lower(F.trim(c))

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(t, p, i)

    long_form, short_form = r"(\d{1,2})\s+de\s+(\p{L}+)\s+(?:del?\s+)?(\d{4})", r"(\d{1,2})[/\-](\p{L}{3,})[/\-](\d{4})"
    numbers, iso = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", r"(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})"
    found = F.coalesce(
        _ymd(part(long_form, 3), month_number(part(long_form, 2)), part(long_form, 1)),
        _ymd(part(short_form, 3), month_number(part(short_form, 2)), part(short_form, 1)),
        _ymd(part(numbers, 3), part(numbers, 2), part(numbers, 1)),
        _ymd(part(iso, 1), part(iso, 2), part(iso, 3)),
    )
    return F.when(~t.rlike("a la fecha|actualidad|actualmente|presente"), found)


def parse_dmy(c: Column) -> Column:
    """Strictly day/month/year, else null."""
    return F.when(c.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$"), F.try_to_date(F.trim(c), "d/M/yyyy"))


def parse_ms_date(c: Column) -> Column:
    """/Date(ms)/ to the UTC day."""
    return F.to_date(F.timestamp_millis(F.regexp_extract(c, r"/Date\((-?\d+)\)/", 1).try_cast("long")))


def iso_or_spanish(c: Column) -> Column:
    return F.coalesce(F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd"), parse_spanish_date(c))


def split_period(c: Column) -> Column:
    """start and end of "d.m.y al d.m.y"; a single date is the start."""
    p = r"(?i)^\s*(.+?)\s+(?:al|hasta(?:\s+el)?)\s+(.+?)\s*$"
    both = F.regexp_extract(c, p, 1) != ""
    return F.struct(
        F.when(both, parse_spanish_date(F.regexp_extract(c, p, 1))).otherwise(parse_spanish_date(c)).alias("start"),
        F.when(both, parse_spanish_date(F.regexp_extract(c, p, 2))).alias("end"),
    )


def years_before(day: Column, years: int = 20) -> Column:
    return F.add_months(day, -12 * years)


def periods_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Inclusive at both ends."""
    return (a <= d) & (c <= b)


def overlap_days(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.least(b, d), F.greatest(a, c)) + 1)


def effective_end(end: Column, issued: Column) -> Column:
    return F.coalesce(end, issued)


def duration_label(days: Column) -> Column:
    """Months of 30.44 days, or days where that is below one."""
    months = days / 30.44
    return F.when(days.isNull(), F.lit(None).cast("string")).when(months < 1, F.format_string("%d días", days)).otherwise(F.format_string("%.1f meses", months))


def covid_label(start: Column, end: Column) -> Column:
    hit = periods_overlap(start, end, F.lit(COVID[0]).cast("date"), F.lit(COVID[1]).cast("date"))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("SI")).otherwise(F.lit("NO"))


def parse_months(c: Column) -> Column:
    """Months in "(24) meses", else in "24 meses"."""
    inside, plain = F.regexp_extract(c, r"(?i)\((\d+)\)\s*meses", 1), F.regexp_extract(c, r"(?i)(\d+)\s*meses", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("int")
