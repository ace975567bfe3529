"""Page dumps, section indexes, embedded arrays, envelopes, sheets, golden rows, jobs; report and call-log sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = r"(?m)^(?:##|---)\s*P[áa]gina\s+\d+"
HEADER = r"^(?:##|---)\s*P[áa]gina\s+(\d+)\s*(?:_([^\s·_]+))?(?:[^\n]*?conf\s+([0-9.]+))?"
FENCE = r"(?s)```[^\n]*\n(.*?)```"


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name) and dump, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("doc_id"), F.col("value").alias("dump"))


def read_page_results(dumps: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, page_num, engine, confidence, text from dumps (doc_id, dump). The text is the first fenced block, else the stripped
    rest of the section (with strict: such pages are left out). All three forms of page headings are read."""
    sections = F.split("dump", rf"(?={PAGE})")
    rows = dumps.select("doc_id", F.explode(sections).alias("part")).where(F.col("part").rlike(rf"^(?:##|---)\s*P[áa]gina\s+\d+"))
    fenced = F.regexp_extract("part", FENCE, 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    has = F.col("part").rlike(FENCE)
    out = rows.select(
        "doc_id", F.regexp_extract("part", HEADER, 1).try_cast("int").alias("page_num"), F.nullif(F.regexp_extract("part", HEADER, 2), F.lit("")).alias("engine"),
        F.regexp_extract("part", HEADER, 3).try_cast("double").alias("confidence"), F.when(has, strip(fenced)).otherwise(body).alias("text"), has.alias("__fenced"),
    )
    return (out.where("__fenced") if strict else out).drop("__fenced")


def write_paged_text(pages: DataFrame, path: str) -> None:
    """A text file folder a document, its pages in order under headings; blank pages are marked."""
    one = F.concat(F.lit("## Página "), F.col("page_num").cast("string"), F.lit("\n\n```\n"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "(sin texto)").otherwise(F.col("text")), F.lit("\n```\n"))
    pages = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", one.alias("t")))), lambda x: x["t"]), "\n").alias("value"))
    pages.write.partitionBy("doc_id").text(path)


def read_sections(dumps: DataFrame) -> DataFrame:
    """Headings "### N. role N°k" of an index: doc_id, index, role, number, separator_page, ranges array<first, last>."""
    rows = dumps.select("doc_id", F.explode(F.split("dump", r"(?m)(?=^###\s*\d+\.)")).alias("part")).where(F.col("part").rlike(r"^###\s*\d+\."))
    head = F.regexp_extract("part", r"^###\s*\d+\.\s*([^\n]*)", 1)
    spans = F.regexp_extract_all("part", F.lit(r"(\d+)\s*[–-]\s*\d+"), F.lit(1))
    ends = F.regexp_extract_all("part", F.lit(r"\d+\s*[–-]\s*(\d+)"), F.lit(1))
    return rows.select(
        "doc_id", F.regexp_extract("part", r"^###\s*(\d+)\.", 1).cast("int").alias("index"), F.trim(F.regexp_replace(head, r"(?i)\s*N[°º]\s*\d+", "")).alias("role"),
        F.regexp_extract(head, r"(?i)N[°º]\s*(\d+)", 1).try_cast("int").alias("number"), F.regexp_extract("part", r"separadora:\*{0,2}\s*(\d+)", 1).try_cast("int").alias("separator_page"),
        F.zip_with(spans, ends, lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))).alias("ranges"),
    )


_VARIABLE = re.compile(r"\bvar\s+(l[A-Z]\w*)\s*=\s*")


def _balanced(text: str, at: int) -> str | None:
    """The array or object that begins at a place, up to its own closing bracket."""
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
        i += 1
    return None


def read_embedded_arrays(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, name, record (JSON text), failed: each record of each "var lName = [...] / {...} / null" of a page. An object is one record,
    null none; what can't be read is one row with failed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch[key].to_pylist(), batch[html].to_pylist()):
                for m in _VARIABLE.finditer(text or ""):
                    if text.startswith("null", m.end()):
                        continue
                    cut = _balanced(text, m.end()) if text[m.end() : m.end() + 1] in ("[", "{") else None
                    try:
                        value = json.loads(cut or "")
                    except ValueError:
                        out.append((k, m[1], None, True))
                        continue
                    out += [(k, m[1], json.dumps(r, ensure_ascii=False), False) for r in (value if isinstance(value, list) else [value])]
            names = [key, "name", "record", "failed"]
            kinds = [batch.schema.field(key).type, pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return pages.select(key, html).mapInArrow(read, f"{key} {dict(pages.dtypes)[key]}, name string, record string, failed boolean")


def record_inventory(records: DataFrame) -> DataFrame:
    return records.groupBy("name").agg(F.count_if(~F.col("failed")).alias("records"), F.count_if("failed").alias("failed"))


def normalize_envelope(df: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON answer that is a list, {Result|data|obras: [...]} or a single object: position and record (VARIANT)."""
    v = F.try_parse_json(column)
    inside = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("Result", "data", "obras")), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return df.withColumn("__rows", inside).select("*", F.posexplode("__rows").alias("position", "record")).drop("__rows")


def extract_html_fields(html: Column, labels: dict[str, str]) -> list[Column]:
    """One column a label: the text after it in a page without scripts, styles and tags."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", "\n")
    return [F.trim(F.regexp_extract(plain, rf"(?i){re.escape(label)}\s*:?\s*\n?\s*([^\n]+)", 1)).alias(name) for name, label in labels.items()]


def type_child_records(records: DataFrame, key: str, spec: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Typed columns from JSON records: each the first non-null of its aliases, cast. spec: name -> (type, aliases)."""
    v = F.try_parse_json("record")
    return records.select(key, *(F.coalesce(*(F.try_variant_get(v, f"$.{a}", "string") for a in aliases)).try_cast(kind).alias(name) for name, (kind, aliases) in spec.items()))


def promote_header(rows: DataFrame, sheet: list[str], row: str, cells: str) -> DataFrame:
    """Rows of cells to records: the first non-empty row of a sheet is the header (blank headers are Col_j), empty rows go, values are trimmed."""
    filled = F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    rows = rows.where(filled).withColumn("__n", F.row_number().over(Window.partitionBy(*sheet).orderBy(row)))
    names = F.transform(cells, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("Col_"), (i + 1).cast("string"))).otherwise(F.trim(c)))
    head = rows.where("__n = 1").select(*sheet, names.alias("__names"))
    values = F.transform(F.slice(cells, 1, F.size("__names")), lambda c: F.trim(c))
    return rows.where("__n > 1").join(head, sheet).select(*sheet, row, F.map_from_arrays(F.slice("__names", 1, F.size(cells)), values).alias("record"))


def sheet_profile(rows: DataFrame, sheet: list[str], cells: str) -> DataFrame:
    filled = F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return rows.groupBy(*sheet).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(cells)).alias("columns"), F.count_if(filled).alias("filled_rows"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden documents to a row a role."""
    kind = "nombre_tdr string, rtm_personal array<struct<numero_fila int, cargo string, profesiones_aceptadas array<string>, experiencia_minima struct<cantidad int, unidad string, cargos_similares_validos array<string>>, tipo_obra_valido string>>"
    return spark.read.schema(kind).json(path, multiLine=True).select("nombre_tdr", F.explode("rtm_personal").alias("r")).select("nombre_tdr", "r.*")


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Model calls, one JSON file or line each; unreadable ones are left out."""
    kind = "job_id string, block_type string, ok boolean, items int, prompt_tokens long, answer_tokens long, seconds double, error string, _corrupt_record string"
    return spark.read.schema(kind).json(path).where("_corrupt_record is null").drop("_corrupt_record")


def call_metrics(calls: DataFrame) -> DataFrame:
    """Per block type: calls, failures, tokens, tokens a second and the device that this tells of."""
    speed = F.sum("answer_tokens") / F.nullif(F.sum("seconds"), F.lit(0.0))
    out = calls.groupBy("block_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.col("prompt_tokens") + F.col("answer_tokens")).alias("tokens"), F.round(speed, 2).alias("tokens_a_second"))
    return out.withColumn("device", F.when(F.col("tokens_a_second") > 200, "GPU").otherwise("CPU"))


def write_call_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").partitionBy("job_id").parquet(path)


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def latest_version(artifacts: DataFrame, key: Column) -> DataFrame:
    return artifacts.groupBy(key.alias("doc")).agg(F.max("path").alias("path"))


def jobs_page(jobs: DataFrame, page: int = 1, per_page: int = 20, kind: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """Jobs by the filters given, newest first, one page, with total and pages."""
    if kind:
        jobs = jobs.where(F.col("job_type") == kind)
    if status:
        jobs = jobs.where(F.col("status") == status)
    if text:
        jobs = jobs.where(F.ilike("filename", F.lit(f"%{text}%")))
    total = jobs.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    return jobs.orderBy(F.desc("created_at"), "id").offset((page - 1) * per_page).limit(per_page).join(F.broadcast(total))  # one row


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
