"""The requirement rows of a document, from split tables and visual reads to the final numbered list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import clean_duration, drop_sparse_rows
from ..functions.text import strip_accents
from ..shared import shuffled
from .anchors import infer_row_numbers
from .fragments import attach_factors
from .merge import copied_signatures, drop_support_roles, guarded_drop, merge_by_precedence, merge_duplicates, skeleton_rows, union_ignoring_case
from .requirements import is_title

# Titles that are real, roles of sections that are no key staff, roles that are special, signs of an invented answer,
# words of table headers, root keys of a list of experiences.
REAL_TITLES = (
    "civil", "sanitario", "electrico", "electricista", "mecanico", "electromecanico", "mecatronico", "electronico", "industrial", "ambiental", "agricola", "agronomo",
    "geologo", "geotecnico", "estructural", "hidraulico", "quimico", "informatico", "telecomunicaciones", "sistemas", "seguridad laboral", "seguridad industrial",
    "seguridad e higiene", "higiene y seguridad", "minas", "materiales", "sistemas y computo", "electronico y telecomunicaciones",
)
META_ROLES = (r"\bconsultor[ií]a\b", r"^consultor\s+de\s+ingenier[ií]a$", r"^modelador\b", r"^especialidad\s*:")
SPECIAL_ROLE = r"(?i)^\s*(especialista|jefe|gestor|director|coordinador|arquitecto|ingeniero)\b"
INVENTED = (
    r"\bejemplo\b", r"\bplantilla\b", r"\bpodría ser\b", r"\basumiendo\b", r"\bgenéric[oa]\b", r"\bno se proporcion[aó]\b", r"\bno se especific[aó]\b", r"\bno se mencion[aó]\b",
    r"\bpara completar\b", r"\bnecesitar[ií]amos\b", r"\bproporcion[ae]s? más detalles\b", r"\bajust[aá][rd][oa]? según\b", r"\bcargo similar [A-Z]\b",
)
HEADER_ROLE, HEADER_EDUCATION = "CARGO|RESPONSABILIDAD", "FORMACION|FORMACIÓN|ACADEMICA|ACADÉMICA"
HEADER_POST, HEADER_TIME, HEADER_WORKS = "CARGO|ROL", "TIEMPO|EXPERIENCIA", "TRABAJOS|PRESTACIONES|ACTIVIDAD"
LAST_NUMBER, UNNUMBERED, SHELL_CONFIDENCE = 30, 99, 0.8
NAME_CHARS = 200


def merge_split_tables(titles: DataFrame, experience: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """Rows of the title table with what the experience table gives for the same keys; keys that only the latter has become shells
    of lower confidence. titles: keys, role, titles, page; experience: keys, months, roles, work, page."""
    left, right = titles.withColumnRenamed("page", "__p"), experience.withColumnRenamed("page", "__q").withColumn("__r", F.lit(1))
    both = left.withColumn("__l", F.lit(1)).join(right, keys, "full")
    none = F.array().cast("array<string>")
    return both.select(
        *keys, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("titles", none).alias("titles"), F.coalesce("roles", none).alias("roles"), "months",
        "work", F.coalesce("__p", "__q").alias("page"), F.when(F.col("__l").isNull(), confidence * SHELL_CONFIDENCE).otherwise(confidence).alias("confidence"),
    )


def is_derived_title(title: Column, role: Column) -> Column:
    """A title made up from the role: "ingeniero en X", where a word of X is, holds or lies in a word of the role and X is no real title."""
    plain, post = (F.trim(strip_accents(F.lower(F.coalesce(c, F.lit(""))))) for c in (title, role))
    suffix = F.trim(F.regexp_extract(plain, r"^(?:ingeniero|arquitecto)\s+(?:en|de)\s+(.{3,})$", 1))
    real = suffix.isin(*REAL_TITLES) | suffix.rlike("^(?:" + "|".join(REAL_TITLES) + ") ")
    of_role = F.filter(F.split(post, r"\s+"), lambda w: (F.length(w) >= 4) & (w != "especialista"))
    of_title = F.filter(F.split(suffix, r"\s+|,"), lambda w: F.length(w) >= 4)
    alike = F.exists(of_title, lambda a: F.exists(of_role, lambda b: F.contains(b, a) | F.contains(a, b)))
    return (F.length(suffix) >= 3) & ~real & alike


def overlay_visual_rows(rows: DataFrame, visual: DataFrame, keys: list[str], inferred: Column | None = None) -> DataFrame:
    """rows, with what a visual read gives for the same keys: lists replace where not empty, without titles derived from the role;
    scalars fill nulls. visual: keys, titles, roles, months, work. Rows without the last key take what the read gives for the number inferred."""
    seen = visual.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in ("titles", "roles", "months", "work")))
    own = [F.col(k) for k in keys[:-1]] + [F.col(keys[-1]) if inferred is None else F.coalesce(F.col(keys[-1]), inferred)]
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f"__k_{k}")) if k != keys[-1] else c == F.col(f"__k_{k}") for c, k in zip(own, keys)))
    out = rows.join(shuffled(seen), same, "left").withColumn("__titles", F.filter("__titles", lambda t: ~is_derived_title(t, F.col("role"))))
    out = out.withColumns({c: F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("titles", "roles")})
    out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in ("months", "work")})
    return out.select(*rows.columns)


def source_number(number: Column, inferred: Column | None = None) -> Column:
    """The row number that orders a document: the stated one if it is from 1 to LAST_NUMBER, else the inferred, else UNNUMBERED."""
    return F.coalesce(F.when(number.between(1, LAST_NUMBER), number), inferred if inferred is not None else F.lit(None), F.lit(UNNUMBERED))


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "row") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def is_meta_role(role: Column) -> Column:
    return role.rlike("(?i)" + "|".join(META_ROLES))


def drop_meta_roles(df: DataFrame, doc: str, role: str) -> DataFrame:
    """In documents with a special role, roles of sections that are no key staff go."""
    c = F.coalesce(F.col(role), F.lit(""))
    return guarded_drop(df, [doc], c.rlike(SPECIAL_ROLE) & ~is_meta_role(c), is_meta_role(c))


def curate_requirements(titles: DataFrame, experience: DataFrame, visual: DataFrame, training: DataFrame, confidence: float = 1.0, texts: DataFrame | None = None) -> DataFrame:
    """doc, number, row and the requirement's columns: split tables joined, visual reads laid over, training attached or added as rows
    of its own, sparse rows, support roles and roles of other sections dropped, and the rest numbered in the document's order.
    All inputs are keyed by (doc, number); training: doc, number, hours. With texts (doc, text), rows without a number from 1 to 30
    are laid over and ordered by the number that their document has next to their role."""
    rows = merge_split_tables(titles, experience, ["doc", "number"], confidence)
    if texts is not None:
        rows = infer_row_numbers(rows, texts, "doc", "role", "text")
    rows = overlay_visual_rows(rows, visual, ["doc", "number"], None if texts is None else F.col("inferred"))
    rows = skeleton_rows(rows, training, ["doc", "number"], "hours").withColumn("role", F.coalesce("role", F.lit("")))
    parts = ["__role", "titles", "roles", "months", "work", "hours"]
    rows = drop_sparse_rows(rows.withColumn("__role", F.nullif("role", F.lit(""))), parts).drop("__role")
    rows = drop_meta_roles(drop_support_roles(rows, "doc", "role"), "doc", "role")
    inferred = F.lit(None).cast("int") if texts is None else F.col("inferred")
    return number_rows(rows, ["doc"], [source_number(F.col("number"), inferred), F.col("number").asc_nulls_last(), F.col("role")])


#: Columns of a requirement row by which a row is sparse, and those of a signature.
ROW_PARTS = ("role", "titles", "roles", "months", "work", "registered", "hours", "factor")


def curate_people(rows: DataFrame, literal: DataFrame, visual: DataFrame, more_titles: DataFrame, training: DataFrame, factors: DataFrame, texts: DataFrame) -> DataFrame:
    """The requirement rows of documents from all their sources, in the order of the whole curation. rows: doc, number, role, titles, roles, months, work,
    registered (a duration as text); literal and visual reads of tables: the same but the visual one without role and registered; more_titles: doc, number, titles;
    training: doc, role, hours; factors: doc, position, factor_role, method, points; texts: doc, text.

    Duplicates of a role are merged; rows without a number get that next to their role in the text; literal rows win lists and work, and come in where a
    number is new; visual ones are laid over; of the further titles and a row's own, where these are not literal, the real ones not made up from the
    role are united; groups of equal titles and roles that no literal row is in are marked for review; training goes to its role or is a row of its own; placeholder durations
    go and none is longer than the months; support and meta roles go; factors come in; sparse rows go; the rest is numbered in the document's order."""
    none = F.array().cast("array<string>")
    keyed = rows.withColumn("__role", F.lower(F.trim("role")))
    first = keyed.groupBy("doc", "__role").agg(F.min("number").alias("number"))
    merged = merge_duplicates(keyed, ["doc", "__role"], ["role", "work", "registered"], ["months"], ["titles", "roles"]).drop("n_merged")
    same = F.col("m.doc").eqNullSafe(F.col("f.doc")) & F.col("m.__role").eqNullSafe(F.col("f.__role"))
    merged = merged.alias("m").join(shuffled(first).alias("f"), same).select("m.*", "f.number").drop("__role")
    merged = infer_row_numbers(merged.withColumns({c: F.coalesce(c, none) for c in ("titles", "roles")}), texts, "doc", "role", "text")
    merged = merged.withColumn("number", F.coalesce(F.when(F.col("number").between(1, LAST_NUMBER), F.col("number")), F.col("inferred").cast("long"), "number")).drop("inferred")
    columns = ["doc", "number", "role", "titles", "roles", "months", "work", "registered"]
    known = merge_by_precedence(merged.where("number is not null").select(columns), literal.select(columns), ["doc", "number"], ["titles", "roles", "work"], ["role", "months", "registered"])
    out = known.unionByName(merged.where("number is null").select(columns).withColumn("source", F.lit("text")))
    out = overlay_visual_rows(out, visual, ["doc", "number"])
    real = lambda c: F.filter(F.coalesce(c, none), lambda t: is_title(t) & ~is_derived_title(t, F.col("role")))
    out = out.join(shuffled(more_titles.select("doc", "number", F.col("titles").alias("__more"))), ["doc", "number"], "left")
    united = union_ignoring_case(real(F.col("__more")), real(F.col("titles")))
    literal_titles = (F.col("source") != "text") & (F.size("titles") > 0)
    out = out.withColumn("titles", F.when(F.col("__more").isNotNull() & ~literal_titles & (F.size(united) > 0), united).otherwise(F.coalesce("titles", none))).drop("__more")
    signature = F.concat_ws("|", F.array_join(F.array_sort("titles"), ","), F.array_join(F.array_sort(F.coalesce("roles", none)), ","))
    out = out.withColumn("__signature", F.when(F.col("source") == "text", F.nullif(signature, F.lit("|"))))
    copied = copied_signatures(out.where("__signature is not null"), ["doc"], [F.col("__signature")], "number").select("doc", F.col("signature").alias("__signature"), F.lit(True).alias("needs_review"))
    out = out.join(shuffled(copied), ["doc", "__signature"], "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(False))).drop("__signature")
    out = skeleton_rows(out.withColumn("__role", F.lower(F.trim("role"))), training.select("doc", F.lower(F.trim("role")).alias("__role"), "hours"), ["doc", "__role"], "hours")
    out = out.withColumns({"role": F.coalesce("role", "__role"), "needs_review": F.coalesce("needs_review", F.lit(False)), **{c: F.coalesce(c, none) for c in ("titles", "roles")}}).drop("__role")
    cleaned = clean_duration(F.col("registered"))
    stated = F.regexp_extract(cleaned, r"(\d+)", 1).try_cast("int")
    out = out.withColumn("registered", F.when((F.col("months") > 0) & (stated > F.col("months")), F.col("months").cast("string")).otherwise(cleaned))
    out = drop_meta_roles(drop_support_roles(out, "doc", "role"), "doc", "role")
    out = attach_factors(out.withColumn("factor", F.lit(None).cast("string")), factors, "doc", "role", "factor")
    out = drop_sparse_rows(out, list(ROW_PARTS))
    return number_rows(out, ["doc"], [source_number(F.col("number")), F.col("number").asc_nulls_last(), F.col("role")])


def valid_person(record: Column) -> Column:
    """record: map of text. It names a person, in at most NAME_CHARS characters, and no key is a page or an entity."""
    name = F.coalesce(record["nombre"], F.lit(""))
    odd = F.exists(F.map_keys(record), lambda k: F.startswith(k, F.lit("Página")) | F.startswith(k, F.lit("&#")))
    return F.coalesce((name != "") & (F.length(name) <= NAME_CHARS) & ~odd, F.lit(False))


def fabricated(answer: Column, items: Column) -> Column:
    """What stands before the first brace reads as made up, and there is no item."""
    return F.substring_index(answer, "{", 1).rlike("(?iU)" + "|".join(INVENTED)) & (F.coalesce(F.size(items), F.lit(0)) <= 0)


def table_header(cells: Column) -> Column:
    """B1 (titles), B2 (experience) or null for the cells of a table's first row."""
    text = F.upper(F.array_join(F.filter(cells, lambda c: c != ""), " "))
    first = text.rlike(HEADER_ROLE) & text.rlike(HEADER_EDUCATION)
    second = text.rlike(HEADER_POST) & (text.rlike(HEADER_TIME) | text.rlike(HEADER_WORKS))
    return F.when(first, "B1").when(second, "B2")


def full_name(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)))
