"""Evaluation: persons with experiences and requirements, nine alerts, verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import effective_end, periods_overlap, years_before
from ..functions.similarity import infer_action, infer_sector, jaccard, match_action, match_role, match_sector, match_title, synonym_groups, synonym_members
from ..functions.text import normalize_role, words
from ..rules import ALERTS, COVID, ROLE_JACCARD


def attach_experiences(persons: DataFrame, experiences: DataFrame, name: str = "name", other: str = "professional_name") -> DataFrame:
    """Persons with their experiences by trimmed lower-case name; persons without any stay."""
    return persons.withColumn("__key", F.lower(F.trim(name))).join(experiences.withColumn("__key", F.lower(F.trim(other))), "__key", "left").drop("__key")


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup of a table with one row a key (company start, registration state)."""
    return df.join(table, key, "left")


def match_requirement(persons: DataFrame, requirements: DataFrame, person: str, role: str, requirement: str, required: str, order: str, scope: list[str]) -> DataFrame:
    """The best requirement of each person, by tier: 1 equal normalised roles, 2 one contains the other, 3 a group of
    synonyms in common, 4 the largest Jaccard of words if at least ROLE_JACCARD; then score and the requirements' order.

    Persons and requirements meet inside a scope (a tender) only, by an equality join on its columns. Roles are matched as
    distinct texts of a scope and the result joined back, so the number of persons does not multiply the pairs."""
    roles = persons.select(*scope, role).distinct().withColumns({"__p": normalize_role(F.col(role)), "__pg": synonym_groups(F.col(role)), "__pm": synonym_members(F.col(role))})
    wanted = requirements.select(*scope, requirement, required, order).withColumns({"__r": normalize_role(F.col(required)), "__rg": synonym_groups(F.col(required)), "__rm": synonym_members(F.col(required))})
    score = jaccard(F.array_distinct(words(F.col("__p"))), F.array_distinct(words(F.col("__r"))))
    inside = (F.col("__p") != "") & (F.col("__r") != "") & (F.contains("__p", "__r") | F.contains("__r", "__p"))
    tier = (
        F.when((F.col("__p") == F.col("__r")) & (F.col("__p") != ""), 1).when(inside, 2)
        .when(F.arrays_overlap("__pg", "__rg") | F.arrays_overlap("__pm", "__rm"), 3).when(score >= ROLE_JACCARD, 4)
    )
    pairs = roles.join(wanted, scope).withColumns({"tier": tier, "score": score}).where("tier is not null")
    best = Window.partitionBy(*scope, role).orderBy("tier", F.when(F.col("tier") == 4, -F.col("score")).otherwise(F.lit(0.0)), order)
    chosen = pairs.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*scope, role, requirement, "tier", F.round("score", 6).alias("score"))
    return persons.join(chosen, [*scope, role], "left")


def _alert(code: str, when: Column, text: str) -> Column:
    found = F.struct(F.lit(code).alias("code"), F.lit(ALERTS[code]).alias("severity"), F.lit(text).alias("description"))
    return F.when(F.coalesce(when, F.lit(False)), found)


def check_alerts(df: DataFrame, window: tuple[str, str] = COVID) -> DataFrame:
    """df with alerts array<code, severity, description>. Columns read where they are there: start_date, end_date, cert_issue_date,
    proposal_date, company_start, role, accepted_roles, required_role, profession, accepted_titles, work_text, required_work,
    registration_active. What is unknown raises nothing."""

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    start, end, issued, day = (col(n, "date") for n in ("start_date", "end_date", "cert_issue_date", "proposal_date"))
    accepted, required = col("accepted_roles", "array<string>"), col("required_role", "string")
    roles = F.when(F.size(accepted) > 0, accepted).when(required.isNotNull(), F.array(required))
    titles, title = col("accepted_titles", "array<string>"), col("profession", "string")
    work = col("required_work", "string")
    a, b = (F.lit(x).cast("date") for x in window)
    found = [
        _alert("ALT01", end > issued, "end after the certificate's issue"),
        _alert("ALT02", periods_overlap(start, end, a, b), "period meets the exclusion window"),
        _alert("ALT03", end < years_before(day), "ended more than 20 years before the proposal"),
        _alert("ALT04", col("company_start", "date") > start, "company began after the experience"),
        _alert("ALT05", end.isNull(), "no end date"),
        _alert("ALT06", (F.size(roles) > 0) & ~match_role(col("role", "string"), roles), "role is not among the valid ones"),
        _alert("ALT07", (F.size(titles) > 0) & title.isNotNull() & ~match_title(title, titles), "title is not among the accepted ones"),
        _alert("ALT08", (F.trim(work) != "") & ~match_sector(col("work_text", "string"), work), "kind of work differs"),
        _alert("ALT09", ~col("registration_active", "boolean"), "registration not active"),
    ]
    return df.withColumn("alerts", F.array_compact(F.array(*found)))


def alert_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row an alert; rows without any get "Sin alertas"."""
    rows = df.select(*keys, F.explode_outer("alerts").alias("a"))
    return rows.select(*keys, F.coalesce("a.code", F.lit("Sin alertas")).alias("code"), F.col("a.severity").alias("severity"))


def verdict(value: Column, yes: str, no: str) -> Column:
    """A nullable boolean as text."""
    return F.when(value, yes).when(~value, no).otherwise("NO EVALUABLE")


def status_colour(c: Column) -> Column:
    return F.when(c.isin("SI", "CUMPLE"), "green").when(c.isin("NO", "NO CUMPLE"), "red").when(c == "NO EVALUABLE", "yellow")


def evaluate_requirements(df: DataFrame) -> DataFrame:
    """df: name, role_applied, profession, folio, role, project_name, work_type, action_type, end_date, cert_issue_date, proposal_date and the requirement's
    requirement_id (null: no requirement found), accepted_titles, accepted_roles, required_role, required_work. Adds the verdict columns."""
    none = F.col("requirement_id").isNull()
    roles = F.when(F.size("accepted_roles") > 0, F.col("accepted_roles")).when(F.col("required_role").isNotNull(), F.array("required_role"))
    blank = F.coalesce(F.trim("required_work"), F.lit("")) == ""
    work = F.coalesce(F.nullif("work_type", F.lit("")), "project_name")
    # In a step of their own: what is inferred is used several times below.
    df = df.withColumns({
        "sector": F.coalesce(F.nullif("work_type", F.lit("")), infer_sector(F.col("project_name"))),
        "action": F.coalesce(F.nullif("action_type", F.lit("")), infer_action(F.col("project_name"))),
        "__wanted_action": infer_action(F.col("required_work")),
    })
    sector, action, wanted_action = F.col("sector"), F.col("action"), F.col("__wanted_action")
    end = effective_end(F.col("end_date"), F.col("cert_issue_date"))

    def judged(value: Column, yes: str, no: str) -> Column:
        return F.when(none, "NO EVALUABLE").otherwise(verdict(value, yes, no))

    out = df.withColumns({
        "required_titles": F.when(~none, F.concat_ws(" / ", "accepted_titles")), "title_ok": judged(match_title(F.col("profession"), F.col("accepted_titles")), "SI", "NO"),
        "valid_roles": F.when(~none, F.concat_ws(" / ", roles)), "role_ok": judged(match_role(F.col("role"), roles), "CUMPLE", "NO CUMPLE"),
        "project_ok": judged(F.when(blank, F.lit(True)).otherwise(match_sector(work, F.col("required_work"))), "SI", "NO"),
        "end_used": end, "end_alert": F.when(F.col("end_date").isNull(), "NO VALE").otherwise(""),
        "sector_ok": judged(F.when(blank, F.lit(True)).otherwise(match_sector(F.coalesce(sector, "project_name"), F.col("required_work"))), "CUMPLE", "NO CUMPLE"),
        "required_action": F.when(none, F.lit(None)).otherwise(F.coalesce(wanted_action, F.lit("El tipo de intervención no importa"))),
        "action_ok": judged(F.when(wanted_action.isNull(), F.lit(True)).otherwise(match_action(action, wanted_action)), "CUMPLE", "NO CUMPLE"),
        "within_20_years": F.when(end >= years_before(F.col("proposal_date")), "SI").otherwise("NO"),
    })
    four = F.array("role_ok", "project_ok", "sector_ok", "action_ok")
    complexity = F.when(F.arrays_overlap(four, F.array(F.lit("NO"), F.lit("NO CUMPLE"))), "NO").when(F.array_contains(four, "NO EVALUABLE"), "NO EVALUABLE").otherwise("SI")
    return out.withColumn("complexity", complexity).drop("__wanted_action")


def run_totals(df: DataFrame, person: str, requirement: str) -> DataFrame:
    critical = F.size(F.filter("alerts", lambda a: a["severity"] == "CRITICAL"))
    return df.agg(
        F.count_distinct(person).alias("persons"), F.count_distinct(F.when(F.col(requirement).isNotNull(), F.col(person))).alias("matched"),
        F.count(F.lit(1)).alias("experiences"), F.sum(F.size("alerts")).cast("long").alias("alerts"), F.sum(critical).cast("long").alias("critical"),
    )


def person_summary(df: DataFrame, person: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Per person: experiences, years (rows with both dates only), alerts, critical alerts."""
    critical = F.size(F.filter("alerts", lambda a: a["severity"] == "CRITICAL"))
    days = F.sum(F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.datediff(end, start)))
    return df.groupBy(person).agg(
        F.count(F.lit(1)).alias("experiences"), F.bround(F.coalesce(days, F.lit(0)) / 365.25, 1).alias("years"),
        F.sum(F.size("alerts")).cast("long").alias("alerts"), F.sum(critical).cast("long").alias("critical"),
    )
