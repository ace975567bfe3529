"""Column expressions that standardise text: accents, stop words, roles, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, and the stop words left out of normalised text.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
STOP_WORDS = ("de", "del", "la", "las", "los", "el", "en", "al", "con", "para", "por", "a", "un", "una", "y", "o", "e")
LEADING_ROLES = "Gestor|Director|Gerente|Coordinador|Jefe|L[ií]der|Supervisor|Responsable|Encargado|Administrador|Representante"
TITLE_PREFIXES = ("ingenier", "arquitect", "bachiller", "licenciad", "tecnico", "contador", "economista", "abogad", "biolog", "geolog", "medic", "quimic", "profesional", "titulo")


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def words(c: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize_text(c: Column) -> Column:
    """Lower case, no accents, punctuation to blanks, no stop words; null gives an empty text."""
    plain = F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " ")
    return F.concat_ws(" ", F.filter(words(plain), lambda w: ~w.isin(*STOP_WORDS)))


def synonym_form(c: Column) -> Column:
    """Lower case, no accents, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def first_of_alternatives(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)^(.*?)(?:\s+y/o\s+.*)?$", 1))


def normalize_role(c: Column) -> Column:
    """The comparable form of a role: of "speciality of X" the X, of "A y/o B" the A, without phrases of action."""
    text = F.trim(F.coalesce(c, F.lit("")))
    speciality = F.regexp_extract(text, r"(?i)especialidad\s+de\s+(.+)$", 1)
    installation = F.regexp_extract(text, r"(?i)^especialista\s+en\s+instalaciones\s+de\s+(.+)$", 1)
    base = first_of_alternatives(text)
    base = F.regexp_replace(base, r"(?i)\s+(?:de(?:l)?|en)\s+(?:la\s+)?(?:elaboración|desarrollo|supervisión|diseño|expediente)(?:\s+\S+)*$", "")
    base = F.regexp_replace(base, rf"(?i)^({LEADING_ROLES})\s+de(?:l)?\s+", "$1 ")
    base = F.regexp_replace(base, r"(?i)seguridad\s+y\s+ejecuci[oó]n", "seguridad y evacuación")
    cut = F.trim(F.regexp_extract(F.lower(F.trim(installation)), r"(?is)^(.*?)(?:(?:,\s*|\s+y/o\s+).*)?$", 1))
    return (
        F.when(speciality != "", F.concat(F.lit("especialista en "), first_of_alternatives(F.lower(F.trim(speciality)))))
        .when(installation != "", F.concat(F.lit("especialista en "), cut))
        .otherwise(F.lower(F.trim(base)))
    )


def gender_neutral(c: Column) -> Column:
    """Final o or a of words of four letters or more becomes @."""
    return F.regexp_replace(F.trim(F.lower(strip_accents(F.coalesce(c, F.lit(""))))), r"(?U)\b(\w{3,})[oa]\b", "$1@")


def role_number(c: Column) -> Column:
    """The last "N° k" of a text."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)N[°º]\s*(\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")


def clean_role(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)\s*N[°º]\s*\d+", ""))


def fix_ocr_typos(c: Column) -> Column:
    """No-break spaces, y/0 for y/o, y/o without blanks, a final cc for co."""
    text = F.regexp_replace(F.regexp_replace(c, " ", " "), r"(?i)\by/0\b", "y/o")
    text = F.regexp_replace(text, r"(?i)(?<=\S)\s*\by/o\b\s*(?=\S)", " y/o ")
    return F.regexp_replace(text, r"(?U)(\w{3,})cc\b", "$1co")


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each group of values that differ in case only, in order."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def split_titles(c: Column) -> Column:
    """Professional titles of a cell: footnote numbers off, parts at y/o or a comma, those with a title's beginning."""
    parts = F.transform(F.split(F.regexp_replace(fix_ocr_typos(c), r"(?<=\D)\d{2,4}(?=\s|,|$)", ""), r"(?i)\s+y/o\s+|,"), lambda x: F.trim(x))
    starts = "^(?:" + "|".join(TITLE_PREFIXES) + ")"
    return distinct_ignoring_case(F.filter(parts, lambda x: F.lower(strip_accents(x)).rlike(starts)))


def split_similar_roles(c: Column) -> Column:
    """Similar roles of a cell, up to its closing phrase, of more than three letters."""
    body = F.regexp_extract(fix_ocr_typos(c), r"(?is)^(.*?)(?:\s+(?:en obras|en la ejecuci|en general|o similares).*)?$", 1)
    return F.filter(F.transform(F.split(body, r"(?i)\s+y/o\s+"), lambda x: F.trim(x)), lambda x: F.length(x) > 3)


def speciality_of_role(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i)(?:asistente|especialista)\s+(?:de|en)\s+(.+)$", 1)), F.lit(""))


def numeric_anchor(c: Column) -> Column:
    """A leading number 1 to 30, as in "N° 3."."""
    n = F.regexp_extract(c, r"(?i)^\s*(?:N[°º]\s*)?(\d{1,2})\s*[.)\-]", 1).try_cast("int")
    return F.when(n.between(1, 30), n)


def numbers_near_roles(c: Column) -> Column:
    """All numbers 1 to 30 that stand before a role's keyword."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?<!\d)(\d{1,2})\s*[.)|\-]?\s*(?:jefe|especialista|gestor|coordinador|residente|supervisor|asistente|ingeniero|arquitecto)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n.between(1, 30)))


def standardize_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_norm for each column."""
    return df.withColumns({f"{c}_norm": normalize_text(F.col(c)) for c in columns})
