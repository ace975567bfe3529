"""Model answers taken in as VARIANT: schema checks, the first valid attempt of a section, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_spanish_date
from ..functions.records import parse_model_json
from ..shared import stored

# The root of a list of experiences and other names that it goes by.
LIST_ROOT, LIST_ROOT_SYNONYMS = "experiencias", ("services", "certificates", "experiences", "certifications")


def part(value: Column, key: str, kind: str = "variant") -> Column:
    """What a variant has under a key, null if that is missing or no such kind."""
    return F.try_variant_get(value, f"$.{key}", kind)


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def list_root(value: Column, root: str = LIST_ROOT, synonyms: tuple[str, ...] = LIST_ROOT_SYNONYMS) -> Column:
    """The list (array of variants) under the root key, or, where the root is missing, under the first of its synonyms that is a list. Null
    if the root is there but no list, or nothing is."""
    lists = [F.when(is_list(part(value, s)), part(value, s, "array<variant>")) for s in synonyms]
    own = F.when(is_list(part(value, root)), part(value, root, "array<variant>"))
    return F.when(part(value, root).isNotNull(), own).otherwise(F.coalesce(*lists))


def is_person(value: Column, most: int = 200) -> Column:
    """A record with a name, a text of at most most characters, and no key that is a page or an entity."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    odd = F.exists(keys, lambda k: F.startswith(k, F.lit("Página")) | F.startswith(k, F.lit("&#")))
    name = F.when(F.schema_of_variant(part(value, "nombre")) == "STRING", part(value, "nombre", "string"))
    return F.coalesce((name != "") & (F.length(name) <= most) & ~odd, F.lit(False))


def choose_attempts(attempts: DataFrame, keys: list[str], attempt: str, valid: Column, filled: Column) -> DataFrame:
    """attempts: keys, attempt, ... One row for each key: of its valid attempts the first that holds anything, else the first; review
    is true, and attempt null, where none is valid. valid and filled are computed on the attempt's row."""
    marked = attempts.withColumns({"__valid": F.coalesce(valid, F.lit(False)), "__empty": ~F.coalesce(filled, F.lit(False))})
    best = marked.groupBy(*keys).agg(F.min(F.when(F.col("__valid"), F.struct(F.col("__empty").alias("e"), F.col(attempt).alias("a")))).alias("__b"))
    return best.select(*keys, F.col("__b.a").alias(attempt), F.col("__b").isNull().alias("review"), F.coalesce(~F.col("__b.e"), F.lit(False)).alias("filled"))


def extraction_lists(attempts: DataFrame, keys: list[str], attempt: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """attempts: keys, attempt, raw (a model's answer). The choice for each key, and the items of the chosen answers: keys, item (variant), place."""
    parsed = stored(parse_model_json(attempts.select(*keys, attempt, raw), raw), "answers").withColumn("__list", list_root(F.col("value")))
    chosen = choose_attempts(parsed, keys, attempt, F.col("__list").isNotNull(), F.size("__list") > 0)
    items = parsed.join(chosen.where("filled").select(*keys, attempt), [*keys, attempt]).select(*keys, F.posexplode("__list").alias("place", "item"))
    return chosen, items


def attach_extractions(sections: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """All sections with what was chosen for them; sections without any attempt are for review."""
    return sections.join(chosen, keys, "left").withColumn("review", F.coalesce("review", F.lit(True)))


def whole_number(value: Column, key: str) -> Column:
    """A number, or a text that is one, as a whole number."""
    text = F.when(F.schema_of_variant(part(value, key)) == "STRING", F.trim(part(value, key, "string")))
    return F.coalesce(F.when(text.isNotNull(), text.try_cast("long")), F.when(text.isNull(), part(value, key, "long")))


def text_list(value: Column) -> Column:
    """The texts of a variant list, trimmed, without blanks and what is no text; empty if it is no list."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    return F.filter(texts, lambda x: x != "")


def visual_rows(df: DataFrame, value: str, fields: dict[str, str], lists: dict[str, str], root: str = "filas") -> DataFrame:
    """Rows of a visual read {root: [{numero, ...}]}: number, texts (name -> key; null if blank) and lists of texts. Rows without a whole number go."""
    rows = df.withColumn("__row", F.explode(part(F.col(value), root, "array<variant>")))
    row = F.col("__row")
    named = {k: F.nullif(F.trim(part(row, v, "string")), F.lit("")) for k, v in fields.items()} | {k: text_list(part(row, v)) for k, v in lists.items()}
    return rows.withColumns({"number": whole_number(row, "numero")} | named).where("number is not null").drop("__row")


def rows_by_number(df: DataFrame, value: str, root: str) -> DataFrame:
    """Rows of a read {root: {number: [texts]}}: number, texts. Keys that are no whole number and values that are no list go."""
    rows = df.select(*df.columns, F.explode(part(F.col(value), root, "map<string,variant>")).alias("__k", "__v"))
    number = F.trim("__k").try_cast("long")
    return rows.where(is_list(F.col("__v")) & number.isNotNull()).withColumns({"number": number, "texts": text_list(F.col("__v"))}).drop("__k", "__v")


def requirement_record(value: Column) -> Column:
    """A requirement's struct: a missing role is empty, a missing unit months; a missing or empty experience is null."""
    given = lambda v, key, default: F.when(part(v, key).isNull(), F.lit(default)).otherwise(part(v, key, "string"))
    exp = part(value, "experiencia_minima")
    there = F.coalesce(F.size(F.map_keys(F.try_variant_get(exp, "$", "map<string,variant>"))) > 0, F.lit(False))
    experience = F.when(there, F.struct(
        part(exp, "cantidad", "int").alias("amount"), given(exp, "unidad", "meses").alias("unit"), part(exp, "descripcion", "string").alias("description"),
        part(exp, "cargos_similares_validos", "array<string>").alias("roles"), part(exp, "puntaje_por_experiencia", "int").alias("points"), part(exp, "puntaje_maximo", "int").alias("most"),
    ))
    return F.struct(
        given(value, "cargo", "").alias("role"), part(value, "profesiones_aceptadas", "array<string>").alias("titles"), part(value, "anos_colegiado", "string").alias("registered"),
        experience.alias("experience"), part(value, "tipo_obra_valido", "string").alias("work"), part(value, "pagina", "int").alias("page"),
    )


def result_count(kind: Column, result: Column, stated: str = "tdr", total: str = "total_cargos", sections: str = "secciones") -> Column:
    """Of a job's result: the stated total for jobs of that kind, else the number of sections (0 without any)."""
    listed = F.coalesce(F.size(part(result, sections, "array<variant>")), F.lit(0))
    return F.when(kind == stated, part(result, total, "int")).otherwise(F.greatest(listed, F.lit(0)))


def flatten_sections(jobs: DataFrame, keys: list[str], result: str) -> tuple[DataFrame, DataFrame]:
    """jobs: keys, result (variant). Professionals and experiences of all sections: keys, section (place), name (a stand-in with the role where
    there is none), and their fields. A day is the one already parsed, if it is one, else read from its text."""
    sections = jobs.select(*keys, F.posexplode(part(F.col(result), "secciones", "array<variant>")).alias("section", "s"))
    s, person = F.col("s"), part(F.col("s"), "profesional")
    role = F.coalesce(part(s, "cargo", "string"), F.lit(""))
    name = F.coalesce(F.nullif(part(person, "nombre", "string"), F.lit("")), F.concat(F.lit("(sin nombre - "), role, F.lit(")")))
    text = lambda v, **names: [part(v, key, "string").alias(n) for n, key in names.items()]
    professionals = sections.select(
        *keys, "section", name.alias("name"), role.alias("role"), F.coalesce(part(s, "numero", "string"), F.lit("")).alias("role_number"),
        *text(person, profession="profesion", college="tipo_colegio", registration="registro_colegio", dni="dni"),
    )
    rows = sections.select(*keys, "section", name.alias("name"), part(person, "dni", "string").alias("dni"), F.posexplode(part(s, "experiencias", "array<variant>")).alias("place", "e"))
    e = F.col("e")
    iso = lambda key: F.try_to_date(part(e, f"{key}_parsed", "string"), "yyyy-MM-dd")
    days = [F.coalesce(iso(key), parse_spanish_date(part(e, key, "string"))).alias(n) for n, key in (("start_date", "fecha_inicio"), ("end_date", "fecha_fin"), ("cert_issue_date", "fecha_emision"))]
    fields = text(
        e, project_name="proyecto", role="cargo", company="empresa_emisora", ruc="ruc", folio="folio", signer="firmante", signer_role="cargo_firmante", work_type="tipo_obra", intervention="tipo_intervencion",
        accreditation="tipo_acreditacion",
    )
    return professionals, rows.select(*keys, "section", "place", "name", "dni", *fields, *days)


def pair_jobs(jobs: DataFrame, tender: str, job: str, kind: str, status: str, ended: str, kinds: tuple[str, str] = ("extraction", "tdr"), done: str = "done") -> DataFrame:
    """tender, extraction_job, requirement_job, state: the latest finished job of either kind of each tender. state: ready, or what is missing."""
    pick = lambda k: F.max(F.when((F.col(kind) == k) & (F.col(status) == done), F.struct(F.col(ended).alias("t"), F.col(job).alias("j"))))["j"]
    pairs = jobs.groupBy(tender).agg(pick(kinds[0]).alias("extraction_job"), pick(kinds[1]).alias("requirement_job"))
    state = F.when(F.col("extraction_job").isNull(), F.lit(f"no {kinds[0]}")).when(F.col("requirement_job").isNull(), F.lit(f"no {kinds[1]}")).otherwise("ready")
    return pairs.withColumn("state", state)


def evaluation_inputs(jobs: DataFrame, pairs: DataFrame, tender: str, job: str, result: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ready pairs: professionals and experiences of the extraction, and requirements (tender, place, requirement) of the other job, by tender, so that one
    run evaluates all tenders."""
    ready = pairs.where("state = 'ready'")
    took = lambda c: jobs.select(F.col(job).alias(c), F.col(result).alias("__result")).join(ready.select(tender, c), c).select(tender, "__result")
    professionals, experiences = flatten_sections(took("extraction_job"), [tender], "__result")
    asked = took("requirement_job").select(tender, F.posexplode(part(F.col("__result"), "rtm_personal", "array<variant>")).alias("place", "r"))
    return professionals, experiences, asked.select(tender, "place", requirement_record(F.col("r")).alias("requirement"))
