"""Tables of a report: whole proposals judged, experience base, verdicts, works, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import covid_label, duration_label, effective_end, years_before
from ..rules import COVID
from .evaluate import attach_experiences, check_alerts, evaluate_requirements, lookup, match_requirement

#: The verdict columns in the order of the report.
VERDICTS = (
    "role_applied", "name", "profession", "required_titles", "title_ok", "folio", "role", "valid_roles", "role_ok", "project_name", "required_role", "project_ok",
    "end_used", "end_alert", "sector", "required_work", "sector_ok", "action", "required_action", "action_ok", "complexity", "within_20_years",
)


def evaluate_proposal(persons: DataFrame, experiences: DataFrame, requirements: DataFrame, companies: DataFrame, registry: DataFrame, scope: list[str], window: tuple[str, str] = COVID) -> DataFrame:
    """One row per person and experience with the alerts and the verdict columns.

    persons: scope, name, role_applied, profession, folio, registration; experiences: professional_name, role, project_name, company,
    dates, work_type, action_type; requirements: scope, requirement_id, wanted (a role), accepted_titles, accepted_roles, required_role, required_work; companies: company,
    company_start; registry: registration, registration_active."""
    best = match_requirement(persons, requirements, "name", "role_applied", "requirement_id", "wanted", "requirement_id", scope)
    chosen = requirements.drop("wanted")
    rows = attach_experiences(best.join(chosen, [*scope, "requirement_id"], "left"), experiences)
    rows = lookup(lookup(rows, companies, "company"), registry, "registration")
    rows = rows.withColumn("work_text", F.coalesce(F.nullif("work_type", F.lit("")), "project_name"))
    return evaluate_requirements(check_alerts(rows, window))


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit(""))


def evaluation_table(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 22 verdict columns as text; null is empty."""
    def shown(c: str) -> Column:
        return date_text(F.col(c)) if c == "end_used" else F.coalesce(F.col(c).cast("string"), F.lit(""))

    return judged.select(*keys, *(shown(c).alias(c) for c in VERDICTS))


def experience_base(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a line an experience: dates as text, the exclusion window, duration, and alerts on issue and age."""
    end = effective_end(F.col("end_date"), F.col("cert_issue_date"))
    rows = rows.withColumn("__end", end)
    days = F.when(F.col("__end") >= F.col("start_date"), F.datediff("__end", "start_date"))
    return rows.select(
        *keys, date_text(F.col("start_date")).alias("start"), date_text(F.col("__end")).alias("end"), covid_label(F.col("start_date"), F.col("__end")).alias("covid"),
        F.coalesce(duration_label(days), F.lit("")).alias("duration"), date_text(F.col("cert_issue_date")).alias("issued"),
        F.when(F.col("__end") > F.col("cert_issue_date"), "ALERTA").otherwise("").alias("issue_alert"),
        F.when(F.col("__end") < years_before(F.col("proposal_date")), "ALERTA").otherwise("").alias("age_alert"),
    )


#: Columns of full_experience_base that are taken as they are, null as an empty text.
BASE_TEXTS = (
    "name", "registration", "project_name", "experience_role", "company", "ruc", "work_type", "accreditation", "folio", "signer", "signer_role", "document_type", "cui", "registry_code",
)


def full_experience_base(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 27 columns of a line an experience, in the report's order. rows: name, registration, dni, project_name, experience_role, company,
    ruc, judged_work_type, work_type, accreditation, start_date, end_date, cert_issue_date, end_used, folio, signer, signer_role, cui, registry_code,
    proposal_date. The registration gives way to the dni, the work type judged to that of the experience, where it is empty; the end is the certificate's
    day where none is given, else the one judged by. Columns kept free, and those that a register has to give, are empty."""
    filled = lambda first, second: F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(second))
    rows = rows.withColumns({
        "registration": filled("registration", "dni"), "work_type": filled("judged_work_type", "work_type"), "document_type": F.col("accreditation"),
        "__end": F.coalesce(effective_end(F.col("end_date"), F.col("cert_issue_date")), "end_used"),
    })
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BASE_TEXTS}
    days = F.when(F.col("__end") >= F.col("start_date"), F.datediff("__end", "start_date"))
    alert = lambda c: F.when(c, "ALERTA").otherwise("")
    none = F.lit("")
    ordered = {
        **{c: text[c] for c in BASE_TEXTS[:8]}, "start": date_text(F.col("start_date")), "end": date_text(F.col("__end")), "covid": covid_label(F.col("start_date"), F.col("__end")), "reserved_1": none, "reserved_2": none,
        "duration": F.coalesce(duration_label(days), F.lit("")), "issued": date_text(F.col("cert_issue_date")), "issue_alert": alert(F.col("__end") > F.col("cert_issue_date")), "folio": text["folio"], "signer": text["signer"],
        "signer_role": text["signer_role"], "signer_alert": none, "company_start": none, "company_alert": none, "age_alert": alert(F.col("__end") < years_before(F.col("proposal_date"))),
        "document_type": text["document_type"], "cui": text["cui"], "registry_code": text["registry_code"], "cross_check": none,
    }
    return rows.select(*keys, *(v.alias(k) for k, v in ordered.items()))


def certificate_works(certificates: DataFrame, works: DataFrame, roles: DataFrame, stops: DataFrame, work: str) -> DataFrame:
    """The ten columns of a line a verified certificate. certificates: person, project, cui, work; works: work, name, status, start; roles: work, kind
    (supervisor, resident), person; stops: work, days. Texts are empty and counts 0 where nothing is known; start as text."""
    names = works.select(work, F.col("name").alias("work_name"), "status", date_text(F.col("start")).alias("work_start"))
    told = works_table(certificates.select("person", "project", "cui", work), names, roles, stops, work)
    texts = ["person", "project", "cui", "work_name", "status", "work_start"]
    return told.select(work, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts), "supervisors", "residents", "stoppages", "suspended_days")


def works_table(links: DataFrame, works: DataFrame, roles: DataFrame, stops: DataFrame, work: str) -> DataFrame:
    """A row per verified certificate: the work, supervisors and residents in charge, stoppages and suspended days.
    works: work, ...; roles: work, kind (supervisor, resident), person; stops: work, days."""
    def named(kind: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("person")))), ", ")

    people = roles.groupBy(work).agg(named("supervisor").alias("supervisors"), named("resident").alias("residents"))
    days = stops.groupBy(work).agg(F.count(F.lit(1)).alias("stoppages"), F.sum("days").cast("long").alias("suspended_days"))
    out = links.join(works, work).join(people, work, "left").join(days, work, "left")
    return out.fillna({"supervisors": "", "residents": "", "stoppages": 0, "suspended_days": 0})


def role_counts(judged: DataFrame, person: str, requirement: str) -> DataFrame:
    """Per person: experiences, those matched to a requirement, alerts."""
    return judged.groupBy(person).agg(F.count(F.lit(1)).alias("experiences"), F.count(requirement).alias("matched"), F.sum(F.size("alerts")).cast("long").alias("alerts"))


def scoring_summary(scored: DataFrame, scores: list[str], selected: Column, group: list[str]) -> DataFrame:
    any_score = F.greatest(*(F.col(c) for c in scores), F.lit(0.0)) > 0
    return scored.groupBy(*group).agg(F.count(F.lit(1)).alias("pages"), F.count_if(any_score).alias("scored"), F.count_if(F.coalesce(selected, F.lit(False))).alias("selected"))


def null_field_trace(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, filled and empty: names of the fields with and without a value; empty text counts as none."""
    def there(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""

    def names(take: bool) -> Column:
        return F.array_compact(F.array(*(F.when(there(c) if take else ~there(c), F.lit(c)) for c in fields)))

    return df.select(*keys, names(True).alias("filled"), names(False).alias("empty"))


def doc_metrics(pages: DataFrame, doc: str, engine: str, confidence: str, engines: list[str]) -> DataFrame:
    """Per document: pages, pages of each engine, pages without one (errors), mean confidence."""
    counts = [F.count_if(F.col(engine) == e).alias(e) for e in engines]
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), *counts, F.count_if(F.col(engine).isNull()).alias("errors"), F.round(F.avg(confidence), 4).alias("confidence"))


def table_stats(pages: DataFrame, doc: str, flagged: Column, valid: Column) -> DataFrame:
    """Per document: pages looked at, flagged as tables, of those validated and failed."""
    ok = F.coalesce(valid, F.lit(False))
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(flagged).alias("flagged"), F.count_if(flagged & ok).alias("validated"), F.count_if(flagged & ~ok).alias("failed"))


def golden_report(compared: DataFrame, doc: str) -> DataFrame:
    """compared: doc, status, expected and found months. Per document: expected, extracted, matched, missing, hallucinated, share of matched
    rows with the same months."""
    status = F.col("status")
    same = F.when(status == "matched", F.col("months").eqNullSafe(F.col("golden_months")).cast("int"))
    return compared.groupBy(doc).agg(
        F.count_if(status != "hallucinated").alias("expected"), F.count_if(status != "missing").alias("extracted"), F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "missing").alias("missing"), F.count_if(status == "hallucinated").alias("hallucinated"), F.round(100 * F.avg(same), 2).alias("months_pct"),
    )


def worst_rows(df: DataFrame, scores: list[str], keys: list[str], n: int = 5) -> DataFrame:
    """The n rows of the lowest mean score; the report's own limit."""
    mean = sum((F.col(c) for c in scores), F.lit(0.0)) / len(scores)
    return df.withColumn("mean", mean).orderBy("mean", *keys).limit(n)
