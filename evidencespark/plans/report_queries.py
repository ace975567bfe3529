"""Queries of curation, evaluation of whole proposals and report tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, records, similarity, text
from ..operators import cells, curate, evaluate, intake, markdown, merge, pages, quality, report, requirements, works
from .base import EXPERIENCES_SQL, PROPOSAL, experiences, read
from ..shared import shuffled, stored
from ..sources import readers
from .registry import ORACLES, query

ROLES = ("Especialista en Costos", "Asistente de obra", "Modelador BIM", "Jefe de Supervision", "Residente", "Consultoria de estudios", "Gestor BIM")
TITLES = ("Ingeniero en Costos", "Ingeniero Civil", "Arquitecto", "Ingeniero de Supervision")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Curation

_ROWS_SQL = f"""
p as (select p_partkey as k, p_partkey // 40 as doc, p_partkey % 40 as number, p_size as size, {_sql_list(ROLES)}[1 + (p_partkey // 3) % 7] as role,
  {_sql_list(TITLES)}[1 + p_partkey % 4] as title, {_sql_list(TITLES)}[1 + (p_partkey // 5) % 4] as seen from part),
t as (select doc, number, role, case when k % 4 = 0 then [] else [title] end as titles, k as page from p where k % 5 <> 0),
e as (select doc, number, case when k % 6 = 0 then null else size end as months, case when k % 7 = 0 then [] else [role] end as roles,
  case when k % 2 = 0 then 'hospital' end as work, k + 1 as page from p where k % 3 <> 0),
v as (select doc, number, case when k % 2 = 0 then [seen, title] else [] end as titles, case when k % 8 = 0 then ['visto'] else [] end as roles, 12 as months, 'puente' as work from p where k % 4 = 1),
tr as (select doc, number, size as hours from p where k % 11 = 0),
j as (select doc, number, coalesce(t.role, '') as role, coalesce(t.titles, []) as titles, coalesce(e.roles, []) as roles, e.months, e.work, coalesce(t.page, e.page) as page,
  case when t.page is null then 0.8 else 1.0 end as confidence from t full join e using (doc, number)),
j2 as (select *, list_filter(v_titles, lambda x: not (x = 'Ingeniero en Costos' and role = 'Especialista en Costos') and not (x = 'Ingeniero de Supervision' and role = 'Jefe de Supervision')) as kept
  from (select j.*, v.titles as v_titles, v.roles as v_roles, v.months as v_months, v.work as v_work from j left join v using (doc, number))),
o as (select doc, number, role, case when len(kept) > 0 then kept else titles end as titles, case when len(v_roles) > 0 then v_roles else roles end as roles,
  coalesce(months, v_months) as months, coalesce(work, v_work) as work, page, confidence from j2),
s as (select doc, number, coalesce(role, '') as role, coalesce(titles, []) as titles, coalesce(roles, []) as roles, months, work, hours, page, confidence from o full join tr using (doc, number)),
f as (select * from s where (role <> '')::int + (len(titles) > 0)::int + (len(roles) > 0)::int + (months is not null)::int + (work is not null)::int + (hours is not null)::int > 1),
g as (select * from (select *, bool_or(lower(role) like '%especialista%') over (partition by doc) as special from f) where not (special and lower(role) like '%asistente%')),
h as (select * from (select *, bool_or(role ilike 'especialista%' or role ilike 'jefe%' or role ilike 'gestor%') over (partition by doc) as special from g)
  where not (special and (role = 'Modelador BIM' or role = 'Consultoria de estudios')))
"""


def _requirement_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(
        k.alias("k"), F.expr("p_partkey div 40").alias("doc"), (k % 40).alias("number"), F.col("p_size").alias("size"), _pick(ROLES, F.expr("p_partkey div 3") % 7).alias("role"),
        _pick(TITLES, k % 4).alias("title"), _pick(TITLES, F.expr("p_partkey div 5") % 4).alias("seen"),
    )
    none = F.array().cast("array<string>")
    titles = p.where("k % 5 <> 0").select("doc", "number", "role", F.when(F.col("k") % 4 == 0, none).otherwise(F.array("title")).alias("titles"), F.col("k").alias("page"))
    experience = p.where("k % 3 <> 0").select(
        "doc", "number", F.when(F.col("k") % 6 != 0, F.col("size")).alias("months"), F.when(F.col("k") % 7 == 0, none).otherwise(F.array("role")).alias("roles"),
        F.when(F.col("k") % 2 == 0, "hospital").alias("work"), (F.col("k") + 1).alias("page"),
    )
    visual = p.where("k % 4 = 1").select(
        "doc", "number", F.when(F.col("k") % 2 == 0, F.array("seen", "title")).otherwise(none).alias("titles"), F.when(F.col("k") % 8 == 0, F.array(F.lit("visto"))).otherwise(none).alias("roles"),
        F.lit(12).alias("months"), F.lit("puente").alias("work"),
    )
    return titles, experience, visual, p.where("k % 11 = 0").select("doc", "number", F.col("size").cast("long").alias("hours"))


@query(f"""with {_ROWS_SQL} select doc, number, role, array_to_string(titles, '|') as titles, array_to_string(roles, '|') as roles, months::bigint as months, work, hours::bigint as hours, confidence::double as confidence,
  row_number() over (partition by doc order by case when number between 1 and 30 then number else 99 end, number, role)::int as row from h""")
def curate_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curate.curate_requirements(*_requirement_rows(spark, sf_dir))
    return out.select("doc", "number", "role", F.array_join("titles", "|").alias("titles"), F.array_join("roles", "|").alias("roles"), F.col("months").cast("long").alias("months"), "work", "hours", F.coalesce("confidence", F.lit(None)).alias("confidence"), "row")


@query(f"""with {_ROWS_SQL.rstrip()} select doc, number, role, page::bigint as page, confidence::double as confidence from j""")
def merge_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, experience, _, _ = _requirement_rows(spark, sf_dir)
    return curate.merge_split_tables(titles, experience, ["doc", "number"], 1.0).select("doc", "number", "role", F.col("page").cast("long").alias("page"), "confidence")


@query(f"""with r as (select p_partkey, {_sql_list(TITLES)}[1 + p_partkey % 4] as title, {_sql_list(ROLES)}[1 + (p_partkey // 3) % 7] as role from part)
select p_partkey, (title = 'Ingeniero en Costos' and role = 'Especialista en Costos') or (title = 'Ingeniero de Supervision' and role = 'Jefe de Supervision') as derived from r""")
def derived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k, curate.is_derived_title(_pick(TITLES, k % 4), _pick(ROLES, F.expr("p_partkey div 3") % 7)).alias("derived"))


@query("""
select doc_id, regexp_matches(lower(split_part(text, '{', 1)), '\\b(ejemplo|plantilla)\\b|cargo similar [a-z]\\b') and lang <> 'en' as fabricated,
  case when lang = 'en' then 'B1' when lang = 'de' then 'B2' end as header, doc_id % 5 <> 0 and doc_id % 7 <> 0 and doc_id % 3 <> 0 as person
from documents""")
def record_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lang = F.col("doc_id"), F.col("lang")
    cells = F.when(lang == "en", F.array(F.lit("Cargo"), F.lit(""), F.lit("Formación"))).when(lang == "de", F.array(F.lit("Rol"), F.lit("tiempo"))).otherwise(F.array(F.lit("Rol")))
    name = F.when(k % 5 == 0, "").when(k % 7 == 0, F.repeat(F.lit("x"), F.lit(201))).otherwise("Ana")
    record = F.create_map(F.lit("nombre"), name, F.when(k % 3 == 0, "Página 12").otherwise("cip"), F.lit("1"))
    items = F.when(lang == "en", F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return read(spark, sf_dir, "documents").select("doc_id", curate.fabricated(F.col("text"), items).alias("fabricated"), curate.table_header(cells).alias("header"), curate.valid_person(record).alias("person"))


# Proposals

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
WORKS = ("construccion de hospital", "supervision de colegio", "mejoramiento de puente", "obra varia")
_RULES_SQL = """
r(rid, wanted, titles, roles, work) as (values (1, 'AUTOMOBILE', ['Arquitecto'], ['urgent'], 'hospital'), (2, 'BUILDING', []::varchar[], ['high', 'medium'], 'supervision de colegio'), (3, 'FURNITURE', ['Ingeniero'], []::varchar[], null))
"""
_JUDGED_SQL = f"""
with {EXPERIENCES_SQL}, {_RULES_SQL},
x as (select c_custkey as person, c_mktsegment as applied, case when c_custkey % 4 = 0 then null when c_custkey % 2 = 0 then 'Arquitecta' else 'Ingeniero' end as profession, c_nationkey % 2 = 0 as active, o.* exclude (person),
    case when experience is null then null else {_sql_list(WORKS)}[1 + experience % 4] end as project, lower(substr(o_orderpriority, 3)) as erole, date '1995-01-01' + (experience % 1000)::int as founded
  from customer left join experiences o on o.person = c_custkey),
y as (select x.*, rid, titles, roles, work, case when rid = 3 then 'furniture' when rid is not null then roles[1] end as one,
    case when project like '%hospital%' then 'salud' when project like '%colegio%' then 'educacion' when project like '%puente%' then 'vial' end as sector,
    case when project like 'construccion%' then 'construccion' when project like 'mejor%' then 'mejoramiento' when project like 'superv%' then 'supervision' end as action
  from x left join r on r.wanted = x.applied),
z as (select *, coalesce(end_date, cert_issue_date) as used,
    case when rid is null then null when len(titles) = 0 then true when profession is null then false else (rid = 1 and profession = 'Arquitecta') or (rid = 3 and profession = 'Ingeniero') end as title_ok,
    case when rid is null then null when erole is null then false when rid = 3 then erole like '%furniture%' else list_contains(roles, erole) end as role_ok,
    case when rid is null then null when work is null then true when contains(project, work) then true else sector = case when rid = 1 then 'salud' else 'educacion' end end as work_ok,
    case when rid is null then null when rid <> 2 then true else action = 'supervision' end as action_ok from y)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    persons = read(spark, sf_dir, "customer").select(
        F.lit(1).alias("tender"), k.cast("string").alias("name"), F.col("c_mktsegment").alias("role_applied"), F.when(k % 4 == 0, None).when(k % 2 == 0, "Arquitecta").otherwise("Ingeniero").alias("profession"),
        F.lit("f").alias("folio"), F.col("c_nationkey").alias("registration"),
    )
    done = experiences(spark, sf_dir).select(
        F.col("person").cast("string").alias("professional_name"), "experience", F.lower(F.expr("substring(o_orderpriority, 3)")).alias("role"), _pick(WORKS, F.col("experience") % 4).alias("project_name"),
        (F.col("experience") % 1000).alias("company"), "start_date", "end_date", "cert_issue_date", F.lit(None).cast("string").alias("work_type"), F.lit(None).cast("string").alias("action_type"), F.lit(PROPOSAL).cast("date").alias("proposal_date"),
    )
    none = F.array().cast("array<string>")
    rules = spark.range(1, 4).select(
        F.lit(1).alias("tender"), F.col("id").alias("requirement_id"), _pick(SEGMENTS, F.col("id") - 1).alias("wanted"), F.when(F.col("id") == 1, F.array(F.lit("Arquitecto"))).when(F.col("id") == 3, F.array(F.lit("Ingeniero"))).otherwise(none).alias("accepted_titles"),
        F.when(F.col("id") == 1, F.array(F.lit("urgent"))).when(F.col("id") == 2, F.array(F.lit("high"), F.lit("medium"))).otherwise(none).alias("accepted_roles"),
        F.when(F.col("id") == 3, "furniture").alias("required_role"), F.when(F.col("id") == 1, "hospital").when(F.col("id") == 2, "supervision de colegio").alias("required_work"),
    )
    companies = done.select("company").distinct().select("company", F.date_add(F.lit("1995-01-01").cast("date"), F.col("company").cast("int")).alias("company_start"))
    registry = persons.select("registration").distinct().select("registration", (F.col("registration") % 2 == 0).alias("registration_active"))
    return report.evaluate_proposal(persons, done, rules, companies, registry, ["tender"], ("1998-03-16", "1999-12-31"))


@query(_JUDGED_SQL + f"""
select person::bigint as person, experience, unnest(case when len(codes) = 0 then ['Sin alertas'] else codes end) as code from (select *, list_filter([
    case when end_date > cert_issue_date then 'ALT01' end, case when start_date <= date '1999-12-31' and date '1998-03-16' <= end_date then 'ALT02' end,
    case when end_date < date '{PROPOSAL}' - interval 20 year then 'ALT03' end, case when founded > start_date then 'ALT04' end, case when end_date is null then 'ALT05' end,
    case when not role_ok then 'ALT06' end, case when profession is not null and not title_ok then 'ALT07' end, case when not work_ok then 'ALT08' end,
    case when not active then 'ALT09' end], lambda x: x is not null) as codes from z)""")
def proposal_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluate import alert_table

    rows = _judged(spark, sf_dir)
    return alert_table(rows.withColumn("person", F.col("name").cast("long")), ["person", "experience"]).select("person", "experience", "code")


@query(_JUDGED_SQL + f"""
, w as (select *, case when rid is null then 'NO EVALUABLE' when title_ok then 'SI' else 'NO' end as title_t, case when rid is null then 'NO EVALUABLE' when role_ok then 'CUMPLE' else 'NO CUMPLE' end as role_t,
    case when work_ok is null then 'NO EVALUABLE' when work_ok then 'SI' else 'NO' end as project_t, case when work_ok is null then 'NO EVALUABLE' when work_ok then 'CUMPLE' else 'NO CUMPLE' end as sector_t,
    case when action_ok is null then 'NO EVALUABLE' when action_ok then 'CUMPLE' else 'NO CUMPLE' end as action_t from z)
select person::bigint as person, experience, applied as role_applied, person::varchar as name, coalesce(profession, '') as profession, coalesce(array_to_string(titles, ' / '), '') as required_titles, title_t as title_ok, 'f' as folio,
  coalesce(erole, '') as role, case when rid is null then '' when rid = 3 then 'furniture' else array_to_string(roles, ' / ') end as valid_roles, role_t as role_ok, coalesce(project, '') as project_name, case when rid = 3 then 'furniture' else '' end as required_role,
  project_t as project_ok, coalesce(strftime(used, '%d/%m/%Y'), '') as end_used, case when end_date is null then 'NO VALE' else '' end as end_alert, coalesce(sector, '') as sector, coalesce(work, '') as required_work,
  sector_t as sector_ok, coalesce(action, '') as action, case when rid is null then '' when rid = 2 then 'supervision' else 'El tipo de intervención no importa' end as required_action, action_t as action_ok,
  case when role_t = 'NO CUMPLE' or project_t = 'NO' or sector_t = 'NO CUMPLE' or action_t = 'NO CUMPLE' then 'NO' when 'NO EVALUABLE' in (role_t, project_t, sector_t, action_t) then 'NO EVALUABLE' else 'SI' end as complexity,
  case when used >= date '{PROPOSAL}' - interval 20 year then 'SI' else 'NO' end as within_20_years from w""")
def evaluation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.evaluation_table(_judged(spark, sf_dir).withColumn("person", F.col("name").cast("long")), ["person", "experience"])


@query(f"""
with {EXPERIENCES_SQL}, b as (select *, coalesce(end_date, cert_issue_date) as used from experiences), d as (select *, case when used >= start_date then used - start_date end as days from b)
select person, experience, strftime(start_date, '%d/%m/%Y') as start, coalesce(strftime(used, '%d/%m/%Y'), '') as "end", case when start_date <= date '2021-12-31' and used >= date '2020-03-16' then 'SI' else 'NO' end as covid,
  case when days is null then '' when days / 30.44 < 1 then days || ' días' else printf('%.1f meses', days / 30.44) end as duration, strftime(cert_issue_date, '%d/%m/%Y') as issued,
  case when used > cert_issue_date then 'ALERTA' else '' end as issue_alert, case when used < date '2017-06-30' - interval 20 year then 'ALERTA' else '' end as age_alert from d""")
def experience_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.experience_base(experiences(spark, sf_dir).withColumn("proposal_date", F.lit("2017-06-30").cast("date")), ["person", "experience"])


@query(f"""
with {EXPERIENCES_SQL},
b as (select e.*, c_name, n_name from (select *, person % 3 as g, experience % 5 as h from experiences) e join customer on c_custkey = person join nation on n_nationkey = c_nationkey),
u as (select *, coalesce(end_date, cert_issue_date) as used from b), d as (select *, case when used >= start_date then used - start_date end as days from u)
select person, experience, c_name as name, case when g = 0 then 'CIP ' || person when g = 1 then 'DNI ' || person else '' end as registration, 'Project ' || experience as project_name, coalesce(case when h <> 2 then o_orderpriority end, '') as experience_role,
  n_name as company, case when h > 0 then '20' || experience else '' end as ruc, case when h = 1 then 'judged' when h = 3 then '' else 'own' end as work_type, case when g = 2 then 'Constancia' else '' end as accreditation,
  strftime(start_date, '%d/%m/%Y') as start, coalesce(strftime(used, '%d/%m/%Y'), '') as "end", case when start_date <= date '2021-12-31' and used >= date '2020-03-16' then 'SI' else 'NO' end as covid, '' as reserved_1, '' as reserved_2,
  case when days is null then '' when days / 30.44 < 1 then days || ' días' else printf('%.1f meses', days / 30.44) end as duration, strftime(cert_issue_date, '%d/%m/%Y') as issued, case when used > cert_issue_date then 'ALERTA' else '' end as issue_alert,
  (experience % 100)::varchar as folio, 'Signer ' || person as signer, case when h = 4 then 'Gerente' else '' end as signer_role, '' as signer_alert, '' as company_start, '' as company_alert,
  case when used < date '2017-06-30' - interval 20 year then 'ALERTA' else '' end as age_alert, case when g = 2 then 'Constancia' else '' end as document_type, experience::varchar as cui, case when h = 0 then 'IO' || experience else '' end as registry_code, '' as cross_check from d""")
def full_experience_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = experiences(spark, sf_dir).join(c, F.col("person") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    g, h, e, p = F.col("person") % 3, F.col("experience") % 5, F.col("experience").cast("string"), F.col("person").cast("string")
    made = {
        "name": F.col("c_name"), "registration": F.when(g == 0, F.concat(F.lit("CIP "), p)).when(g == 1, ""), "dni": F.when(g == 1, F.concat(F.lit("DNI "), p)), "project_name": F.concat(F.lit("Project "), e),
        "experience_role": F.when(h != 2, F.col("o_orderpriority")), "company": F.col("n_name"), "ruc": F.when(h > 0, F.concat(F.lit("20"), e)), "judged_work_type": F.when(h == 1, "judged").when(h == 3, ""),
        "work_type": F.when(h != 3, "own"), "accreditation": F.when(g == 2, "Constancia"), "end_used": F.lit(None).cast("date"), "folio": F.col("experience") % 100, "signer": F.concat(F.lit("Signer "), p),
        "signer_role": F.when(h == 4, "Gerente"), "cui": F.col("experience"), "registry_code": F.when(h == 0, F.concat(F.lit("IO"), e)), "proposal_date": F.lit("2017-06-30").cast("date"),
    }
    return report.full_experience_base(rows.withColumns(made), ["person", "experience"])


@query("""
with p as (select l_partkey, string_agg(distinct case when l_linenumber % 2 = 0 then l_suppkey::varchar end, ', ' order by case when l_linenumber % 2 = 0 then l_suppkey::varchar end) as supervisors,
  string_agg(distinct case when l_linenumber % 2 = 1 then l_suppkey::varchar end, ', ' order by case when l_linenumber % 2 = 1 then l_suppkey::varchar end) as residents from lineitem where l_partkey % 3 <> 0 group by 1),
s as (select l_partkey, count(*) as stoppages, sum(l_quantity::bigint - 25)::bigint as suspended_days from lineitem where l_quantity::bigint > 25 and l_partkey % 2 = 0 group by 1)
select o_orderkey, work, person, project, cui, p_name as work_name, case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'En ejecución' else 'Paralizado' end as status, case when p_size % 4 = 0 then '' else strftime(date '1990-01-01' + p_size * 30, '%d/%m/%Y') end as work_start,
  coalesce(supervisors, '') as supervisors, coalesce(residents, '') as residents, coalesce(stoppages, 0)::bigint as stoppages, coalesce(suspended_days, 0)::bigint as suspended_days
from (select o_orderkey, 'Person ' || o_custkey as person, case when o_orderkey % 5 = 0 then '' else 'Project ' || o_orderkey end as project, o_orderkey::varchar as cui, o_orderkey % (select count(*) from part) as work from orders) o
join part on p_partkey = work left join p on p.l_partkey = work left join s on s.l_partkey = work""")
def certificate_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    size = F.col("p_size")
    registry = part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("name"), F.when(size % 3 == 1, "En ejecución").when(size % 3 == 2, "Paralizado").alias("status"), F.when(size % 4 != 0, F.date_add(F.lit("1990-01-01").cast("date"), size * 30)).alias("start"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work"), "l_linenumber", F.col("l_suppkey").cast("string").alias("person"), (F.col("l_quantity").cast("long") - 25).alias("days"))
    roles = lines.where("work % 3 <> 0").withColumn("kind", F.when(F.col("l_linenumber") % 2 == 0, "supervisor").otherwise("resident"))
    key = F.col("o_orderkey")
    certs = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("Person "), F.col("o_custkey").cast("string")).alias("person"), F.when(key % 5 != 0, F.concat(F.lit("Project "), key.cast("string"))).alias("project"), key.cast("string").alias("cui"),
        (key % part.count()).alias("work"),
    )
    out = report.certificate_works(certs, registry, roles, lines.where("days > 0 and work % 2 = 0"), "work")
    return out.withColumn("o_orderkey", F.col("cui").cast("long"))


@query("""
with p as (select l_partkey, string_agg(distinct case when l_linenumber % 2 = 0 then l_suppkey::varchar end, ', ' order by case when l_linenumber % 2 = 0 then l_suppkey::varchar end) as supervisors,
  string_agg(distinct case when l_linenumber % 2 = 1 then l_suppkey::varchar end, ', ' order by case when l_linenumber % 2 = 1 then l_suppkey::varchar end) as residents from lineitem group by 1),
s as (select l_partkey, count(*) as stoppages, sum(l_quantity::bigint - 25)::bigint as suspended_days from lineitem where l_quantity::bigint > 25 group by 1)
select p_partkey, p_name, coalesce(supervisors, '') as supervisors, coalesce(residents, '') as residents, coalesce(stoppages, 0)::bigint as stoppages, coalesce(suspended_days, 0)::bigint as suspended_days
from part left join p on p.l_partkey = p_partkey left join s on s.l_partkey = p_partkey""")
def works_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", F.col("l_suppkey").cast("string").alias("person"), (F.col("l_quantity").cast("long") - 25).alias("days"))
    roles = lines.withColumn("kind", F.when(F.col("l_linenumber") % 2 == 0, "supervisor").otherwise("resident"))
    return report.works_table(part.select("p_partkey"), part, roles, lines.where("days > 0"), "p_partkey")


# Summaries

@query("""
select user_id, arg_max(case when event_type = 'click' then event_id end, case when event_type = 'click' then ts end) as clicked, arg_max(case when event_type = 'view' then event_id end, case when event_type = 'view' then ts end) as viewed
from events group by 1""")
def latest_event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", *(F.when(F.col("event_type") == t, F.col("event_id")).alias(n) for t, n in (("click", "clicked"), ("view", "viewed"))))
    return works.latest_progress(e, "user_id", "ts", ["clicked", "viewed"])


@query("""
select source, count(*) as pages, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de, count(*) filter (lang is null) as errors, round(avg(n_chars), 4) as confidence from documents group by 1""")
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.doc_metrics(read(spark, sf_dir, "documents"), "source", "lang", "n_chars", ["en", "de"])


@query("""
select source, count(*) as pages, count(*) filter (contains(text, '#')) as flagged, count(*) filter (contains(text, '#') and n_chars > 500) as validated, count(*) filter (contains(text, '#') and n_chars <= 500) as failed from documents group by 1""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_stats(read(spark, sf_dir, "documents"), "source", F.contains("text", F.lit("#")), F.col("n_chars") > 500)


@query("""
select doc_id, array_to_string(list_filter(['lang', 'source', 'text'], lambda f: (f = 'lang' and lang = 'en') or (f = 'source' and doc_id % 3 <> 0) or f = 'text' and trim(text) <> ''), ',') as filled,
  array_to_string(list_filter(['lang', 'source', 'text'], lambda f: (f = 'lang' and lang <> 'en') or (f = 'source' and doc_id % 3 = 0) or f = 'text' and trim(text) = ''), ',') as empty from documents""")
def null_field_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("  ").alias("source"), "text")
    return report.null_field_trace(d, ["doc_id"], ["lang", "source", "text"]).select("doc_id", F.array_join("filled", ",").alias("filled"), F.array_join("empty", ",").alias("empty"))


@query("""
with g as (select p_partkey // 40 as doc, p_partkey as no, p_name as name, p_size as months from part where p_partkey % 5 <> 0), f as (select p_partkey // 40 as doc, p_partkey as no, p_size + (p_partkey % 3 = 0)::int as months from part where p_partkey % 7 <> 0)
select doc, count(*) filter (g.no is not null) as expected, count(*) filter (f.no is not null) as extracted, count(*) filter (g.no is not null and f.no is not null) as matched, count(*) filter (f.no is null) as missing,
  count(*) filter (g.no is null) as hallucinated, round(100.0 * avg(case when g.no is not null and f.no is not null then (g.months = f.months)::int end), 2) as months_pct from g full join f using (doc, no) group by 1""")
def golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("doc"), F.col("p_partkey").alias("no"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("months"))
    found = p.where("no % 7 <> 0").withColumn("months", F.col("months") + F.when(F.col("no") % 3 == 0, 1).otherwise(0))
    golden = p.where("no % 5 <> 0")
    rows = quality.match_golden(found, golden, "doc", "no", "name")
    rows = rows.join(shuffled(golden.select("doc", F.col("name").alias("golden_name"), F.col("months").alias("golden_months"))), ["doc", "golden_name"], "left")
    return report.golden_report(rows.join(shuffled(found.select("doc", F.col("name").alias("found_name"), "months")), ["doc", "found_name"], "left"), "doc")


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber, (0.0 + l_discount + l_tax) / 2 as mean from lineitem order by 3, 1, 2 limit 5""")
def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.worst_rows(read(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "mean")


# Model answers and tables of cells

_ITEM_SQL = """'{"numero": ' || case <k> % 4 when 0 then <k>::varchar when 1 then '" ' || <k> || ' "' when 2 then '"x"' else 'null' end || ', "cargo": " Jefe ' || source || ' ", "titulos": [" Civil ", 7, "", "Sanitario"], "tipo": "' || case <k> % 3 when 0 then ' ' else lang end || '"}'"""


def _answer_sql(k: str, form: str) -> str:
    item = _ITEM_SQL.replace("<k>", k)
    return f"""case {form} when 0 then '{{"experiencias": [' || {item} || ', ' || {item} || ']}}' when 1 then '{{"experiencias": []}}' when 2 then '{{"experiencias": "x", "services": []}}' when 3 then 'no answer' when 4 then '{{"certificates": [' || {item} || ']}}' when 5 then '{{"experiencias": null}}' else '[1]' end"""


_ATTEMPTS_SQL = f"""
t as (select doc_id, 1 as attempt, {_answer_sql("doc_id", "doc_id % 7")} as raw from documents union all select doc_id, 2, {_answer_sql("(doc_id + 1)", "doc_id // 7 % 7")} from documents where doc_id % 10 <> 0),
p as (select doc_id, attempt, case when json_valid(raw) then raw::json end as j from t),
l as (select doc_id, attempt, case when json_type(j, '$.experiencias') is not null then case when json_type(j, '$.experiencias') = 'ARRAY' then json_extract(j, '$.experiencias') end when json_type(j, '$.services') = 'ARRAY' then json_extract(j, '$.services') when json_type(j, '$.certificates') = 'ARRAY' then json_extract(j, '$.certificates') end as items from p),
b as (select doc_id, min(case when items is not null then (json_array_length(items) = 0)::int * 10 + attempt end) as best from l group by 1)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts a document, in fences or bare: lists, empty ones, under other names, no list, null, no JSON."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")

    def answer(k: Column, form: Column) -> Column:
        n = k.cast("string")
        number = F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit('" '), n, F.lit(' "'))).when(k % 4 == 2, '"x"').otherwise("null")
        item = F.concat(F.lit('{"numero": '), number, F.lit(', "cargo": " Jefe '), "source", F.lit(' ", "titulos": [" Civil ", 7, "", "Sanitario"], "tipo": "'), F.when(k % 3 == 0, " ").otherwise(F.col("lang")), F.lit('"}'))
        forms = (
            F.concat(F.lit('```json\n{"experiencias": ['), item, F.lit(", "), item, F.lit("]}\n```")), F.lit('{"experiencias": []}'), F.lit('{"experiencias": "x", "services": []}'), F.lit("no answer"),
            F.concat(F.lit('<think>{"a": 1}</think>{"certificates": ['), item, F.lit("]}")), F.lit('{"experiencias": null}'), F.lit("[1]"),
        )
        return F.coalesce(*(F.when(form == i, f) for i, f in enumerate(forms)))

    k = F.col("doc_id")
    first = d.select("doc_id", F.lit(1).alias("attempt"), answer(k, k % 7).alias("raw"))
    return first.unionByName(d.where("doc_id % 10 <> 0").select("doc_id", F.lit(2).alias("attempt"), answer(k + 1, F.expr("doc_id div 7 % 7")).alias("raw")))


@query(f"with {_ATTEMPTS_SQL} select doc_id, (best % 10)::int as attempt, best is null as review, coalesce(best < 10, false) as filled from b")
def chosen_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.extraction_lists(_attempts(spark, sf_dir), ["doc_id"], "attempt", "raw")[0]


@query(f"""
with {_ATTEMPTS_SQL}, i as (select doc_id, unnest(json_extract(items, '$[*]')) as e from l join b using (doc_id) where best < 10 and attempt = best)
select doc_id, number, role, titles, kind from (select doc_id, try_cast(trim(e->>'numero') as bigint) as number, trim(e->>'cargo') as role, 'Civil,Sanitario' as titles, nullif(trim(e->>'tipo'), '') as kind from i) where number is not null""")
def extracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, items = intake.extraction_lists(_attempts(spark, sf_dir), ["doc_id"], "attempt", "raw")
    as_read = items.select("doc_id", F.try_parse_json(F.concat(F.lit('{"filas": ['), F.col("item").cast("string"), F.lit("]}"))).alias("value"))
    out = intake.visual_rows(as_read, "value", {"role": "cargo", "kind": "tipo"}, {"titles": "titulos"})
    return out.select("doc_id", "number", "role", F.array_join("titles", ",").alias("titles"), "kind")


@query("""
select p_partkey, case p_partkey % 3 when 0 then 'Jefe ' || p_name when 1 then '' end as role, case p_partkey % 4 when 1 then 'meses' when 2 then 'horas' end as unit, case when p_partkey % 4 in (1, 2) then p_size end as amount,
  case when p_partkey % 5 = 0 then p_brand || '|' || p_type end as titles, (case when p_partkey % 2 = 0 then p_size else 0 end)::int as count from part""")
def requirement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with missing, null and empty parts; the number of sections of a job's result."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    role = F.when(k % 3 == 0, F.concat(F.lit('"cargo": "Jefe '), "p_name", F.lit('", '))).when(k % 3 == 1, F.lit("")).otherwise('"cargo": null, ')
    size = F.col("p_size").cast("string")
    exp = F.when(k % 4 == 0, "null").when(k % 4 == 1, F.concat(F.lit('{"cantidad": '), size, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit('{"cantidad": '), size, F.lit(', "unidad": "horas"}'))).otherwise("{}")
    titles = F.when(k % 5 == 0, F.concat(F.lit('"profesiones_aceptadas": ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"], '))).otherwise("")
    value = F.try_parse_json(F.concat(F.lit("{"), role, titles, F.lit('"experiencia_minima": '), exp, F.lit("}")))
    result = F.try_parse_json(F.when(k % 4 == 0, F.concat(F.lit('{"total_cargos": '), size, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit('{"secciones": ['), F.array_join(F.array_repeat(F.lit("1"), F.col("p_size")), ","), F.lit("]}"))).otherwise("{}"))
    out = p.select("p_partkey", intake.requirement_record(value).alias("r"), intake.result_count(F.when(k % 4 == 0, "tdr").otherwise("full"), result).alias("count"))
    return out.select("p_partkey", "r.role", "r.experience.unit", "r.experience.amount", F.array_join("r.titles", "|").alias("titles"), "count")


_CELLS_SQL = """
r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as i from lineitem),
e as (select l_orderkey as k, i, case when l_partkey % 9 = 0 then 'x' else (l_linenumber % 3)::varchar end as n, case when l_suppkey % 5 = 0 then '' else 'Jefe ' || l_partkey end as role, case when l_suppkey % 2 = 0 then '' else 'Grado ' || l_suppkey end as edu from r where not (l_orderkey % 5 = 4 and i > 1)),
c as (select k, n::bigint as n, i, role, edu from e where n <> 'x' and role <> '' and k % 5 <> 4 and not (k % 5 = 3 and i % 4 = 0) and not (k % 5 = 2))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order a table: headers as expected, in another order, of other words (so columns go by their defaults and hold no number), with short rows, and
    tables of a header alone."""
    lines = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    k = F.col("l_orderkey")
    rows = curate.number_rows(lines, ["l_orderkey"], [F.col(c) for c in order], "i").where("not (l_orderkey % 5 = 4)")
    number = F.when(F.col("l_partkey") % 9 == 0, "x").otherwise((F.col("l_linenumber") % 3).cast("string"))
    role = F.when(F.col("l_suppkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" Jefe "), F.col("l_partkey").cast("string")))
    edu = F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise(F.concat(F.lit("Grado "), F.col("l_suppkey").cast("string")))
    plain, turned = F.array(number, role, edu), F.array(edu, role, number)
    cut = F.when((k % 5 == 3) & (F.col("i") % 4 == 0), F.array(number)).otherwise(plain)
    body = rows.select(k.alias("k"), F.col("i").cast("long").alias("i"), F.when((k % 5).isin(1, 2), turned).otherwise(cut).alias("cells"))
    words = lambda *x: F.array(*map(F.lit, x))
    header = F.when(k % 5 == 0, words("N°", "Cargo y/o responsabilidad", "Formación académica")).when(k % 5 == 1, words("Formacion", " cargo ", "nro")).when(k % 5 == 2, words("a", "b", "c")).otherwise(words(None, "Responsabilidad", "academica"))
    heads = lines.select("l_orderkey").distinct().select(k.alias("k"), F.lit(0).cast("long").alias("i"), header.alias("cells"))
    return body.unionByName(heads)


@query(f"with {_CELLS_SQL} select k, n as number, arg_min(role, i) as role, coalesce(arg_min(edu, i) filter (edu <> ''), '') as education from c group by 1, 2")
def columns_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.title_rows(cells.raw_tables(_cells(spark, sf_dir), ["k"], "i", "cells"), ["k"], "i", "cells")


# Tables in pages and the texts of sections

_MADE_SQL = r"""
o as (select doc_id, coalesce(text, '') as text, list_filter(string_split(coalesce(text, ''), ' '), lambda x: regexp_full_match(x, '[A-Za-z]+')) as w from documents),
made as (select doc_id, case when doc_id % 5 = 0 then text || chr(10) else '' end || case when doc_id % 3 > 0 then '| A | B | C |' || chr(10) || '|---|:-:|---|' || chr(10) else '' end || array_to_string(list_transform(range(doc_id % 12), lambda i: '| ' || coalesce(w[3 * i + 1], '') || ' | '
  || coalesce(w[3 * i + 2], '') || ' | ' || coalesce(w[3 * i + 3], '') || case when (i + doc_id) % 7 = 5 then ' | more' else '' end || case when (i * doc_id) % 11 = 7 then ' | more | and more | and | more' else '' end || case when doc_id % 4 = 3 then '' else ' |' end), chr(10)) as text from o)"""


def _made_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a document's words, with up to eleven rows, a rule below its header or none, and rows of more columns; below the document, for some."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", F.filter(F.split("text", " "), lambda x: x.rlike("^[A-Za-z]+$")))
    k = F.col("doc_id")
    at = lambda i: F.coalesce(F.get("w", i.cast("int")), F.lit(""))
    row = lambda i: F.concat(
        F.lit("| "), at(3 * i), F.lit(" | "), at(3 * i + 1), F.lit(" | "), at(3 * i + 2), F.when((i + k) % 7 == 5, " | more").otherwise(""),
        F.when((i * k) % 11 == 7, " | more | and more | and | more").otherwise(""), F.when(k % 4 == 3, "").otherwise(" |"),
    )
    rows = F.when(k % 12 > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 12 - 1), row), "\n")).otherwise("")
    head = F.when(k % 3 > 0, "| A | B | C |\n|---|:-:|---|\n").otherwise("")
    return d.select("doc_id", F.concat(F.when(k % 5 == 0, F.concat("text", F.lit("\n"))).otherwise(""), head, rows).alias("text"))


_BARS = "length(x) - length(replace(x, '|', ''))"


@query(f"""
with {_MADE_SQL}, l as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\x0b\x0c\r')), lambda x: contains(x, '|')) as own from made),
m as (select doc_id, text, own, len(own) as n, list_transform(own, lambda x: {_BARS}) as bars, list_filter(own, lambda x: not contains(x, '---')) as body from l),
k as (select *, list_transform(body, lambda x: {_BARS}) as data, list_filter(flatten(list_transform(body, lambda x: list_transform(string_split(x, '|'), lambda c: trim(c, E' \t\n\x0b\x0c\r')))), lambda c: c <> '') as cells from m),
v as (select *, case when len(data) > 0 then list_max(data) - list_min(data) else list_max(bars) - list_min(bars) end as spread, len(data) as rows, list_max(bars) - 1 as columns, list_sum(list_transform(cells, lambda c: length(c))) / nullif(len(cells), 0) as mean, len(body) < n as rule from k),
s as (select *, round(case when spread = 0 then 0.35 when spread = 1 then 0.2 else 0 end + case when rows >= 10 then 0.25 when rows >= 5 then 0.2 when rows >= 3 then 0.15 else 0.05 end + case when rule then 0.15 else 0 end + case when mean between 3 and 200 then 0.15 when mean > 200 then 0.05 else 0 end + 0.1, 2) as sc,
  case when n = 0 then 'no table' when n < 3 then 'rows' when columns < 3 then 'columns' when spread > case when rows >= 8 then 5 else 3 end then 'uneven' when length(text) / n < 4 then 'short' end as bad from v)
select doc_id, (case bad when 'no table' then 0 when 'rows' then 0.1 when 'columns' then 0.15 when 'uneven' then 0.1 when 'short' then 0.05 else sc end)::double as score, (case when bad = 'no table' then 0 when bad is null then rows else n end)::int as rows,
  (case when bad in ('no table', 'rows') then 0 else columns end)::int as columns, coalesce(bad, case when sc >= 0.5 then 'ok' else 'score' end) as reason from s""")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_tables(spark, sf_dir).select("doc_id", markdown.table_quality(F.col("text")).alias("q")).select("doc_id", "q.score", "q.rows", "q.columns", "q.reason")


@query(_MADE_SQL.replace("\no as", "with o as", 1) + r""",
l as (select doc_id, text, string_split(text, chr(10)) as lines from made),
k as (select *, len(list_filter(lines, lambda x: starts_with(trim(x, E' \t\x0b\x0c\r'), '|'))) as tables, list_filter(lines, lambda x: not (starts_with(trim(x, E' \t\x0b\x0c\r'), '|') and list_max(list_transform(string_split(x, '|'), lambda c: length(trim(c, E' \t\x0b\x0c\r')))) > 9
  and len(list_filter(string_split(x, '|'), lambda c: trim(c, E' \t\x0b\x0c\r') <> '' and not regexp_full_match(replace(trim(c, E' \t\x0b\x0c\r'), ' ', ''), '[-:]*'))) <= 4)) as kept from l)
select doc_id, md5(case when length(text) > 60 and tables >= 3 then array_to_string(kept, chr(10)) else text end) as digest, (length(text) > 60 and tables >= 3 and len(kept) < len(lines)) as cut from k""")
def narrow_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of over 9 letters and up to 4 filled ones count as wide here, in pages of over 60 characters."""
    out = _made_tables(spark, sf_dir).withColumn("cut", markdown.drop_wide_rows(F.col("text"), 60, 9, 4))
    return out.select("doc_id", F.md5("cut").alias("digest"), (F.col("cut") != F.col("text")).alias("cut"))


@query("""
with k as (select doc_id, doc_id % 7 as s, doc_id % 50 as a, doc_id % 3 as g, source from documents)
select doc_id, s::int as section, case g when 0 then a || '-' || (a + 5) || ',' || (a + 9) || '-' || (a + 12) when 1 then a || '-' || (a + 3) else (a + 1) || '-' || (a + 2) end as ranges from k
union all select doc_id, 8, case g when 0 then '1-2' else '7-9' end from k where g < 2 and s <> 0""")
def section_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index tables in either layout; where both are in one text, rows of the narrow one don't count; a section twice; rows without a number."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    s, a, g = (F.col("doc_id") % 7).cast("string"), F.col("doc_id") % 50, F.col("doc_id") % 3
    n = lambda k: (a + k).cast("string")
    head, foot = F.lit("intro\n| # | Cargo | N° | Págs | Bloques | Inicio |\n|---|---|---|---|---|---|\n"), F.lit("\nend | 4 |")
    wide = F.concat(F.lit("| "), s, F.lit(" | Jefe | 1 | 9 | "), n(0), F.lit("–"), n(5), F.lit(" · "), n(9), F.lit("-"), n(12), F.lit(" | 1 |\n| 8 | Otro |  | 2 | 1–2 | 1 |\n| 5 | Narrow | 2 | 3 | 4 |"))
    narrow = F.concat(F.lit("| "), s, F.lit(" | "), "source", F.lit(" | 4 | "), n(0), F.lit(" | "), n(3), F.lit(" |\n| 8 | Otro | 2 | 7 | 9 |\n| x | No | 2 | 7 | 9 |"))
    twice = F.concat(F.lit("| "), s, F.lit(" | A | 2 | 1 | 1 |\n| "), s, F.lit(" | B | 2 | "), n(1), F.lit(" | "), n(2), F.lit(" |"))
    zero = F.when(s == "0", F.regexp_replace(F.when(g == 0, wide).otherwise(narrow), r"\n\| 8 [^\n]*", "")).otherwise(F.when(g == 0, wide).otherwise(narrow))
    text = F.concat(head, F.when(g < 2, zero).otherwise(twice), foot)
    out = markdown.section_index(d.select("doc_id", text.alias("text")), "doc_id", "text")
    return out.select("doc_id", "section", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",").alias("ranges"))


@query("""
with n as (select doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, '') || chr(10) || doc_id % 4 || chr(10) || ' 1 ' || chr(10) || 'x' || chr(10) || '02' || chr(10) || doc_id % 5, chr(10)), lambda x: trim(x, E' \\t\\x0b\\x0c\\r')), lambda x: regexp_full_match(x, '[0-9]{1,2}')), lambda x: x::int) as n from documents)
select doc_id, len(list_filter(range(2, len(n) + 1), lambda i: n[i] = n[i - 1] + 1))::int as runs from n""")
def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat_ws("\n", F.coalesce("text", F.lit("")), (F.col("doc_id") % 4).cast("string"), F.lit(" 1 "), F.lit("x"), F.lit("02"), (F.col("doc_id") % 5).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", markdown.number_runs(own).alias("runs"))


@query(r"""
with p as (select doc_id // 6 as section, least(doc_id % 6 // 2, doc_id // 6 % 3) as block, doc_id as page, coalesce(text, '') as text, regexp_matches(coalesce(text, ''), '@') as inc, regexp_matches(coalesce(text, ''), '[#|!]') as exc from documents),
c as (select *, length(text) < 200 or inc or not exc as useful, case when length(trim(text, ' ')) >= 200 then case when inc then 'anexo16' when regexp_matches(text, '[0-9]{4}') then 'certificados' when exc then 'diplomas' else 'ruido' end end as class from p),
w as (select *, max(block) over (partition by section) + 1 as blocks, sum(case when useful then length(text) else 0 end) over (partition by section, block) as kept, bool_or(class = 'anexo16') over (partition by section) as a, bool_or(class = 'diplomas') over (partition by section) as d, bool_or(class = 'certificados') over (partition by section) as e from c),
s as (select *, useful or kept < 100 as shown from w),
k as (select section, 'person' as kind, page, text, case when blocks < 2 and class = 'diplomas' then 1 else 0 end as rank from s where case when blocks >= 2 then block = 1 and shown when coalesce(a, false) or coalesce(d, false) then coalesce(class in ('anexo16', 'diplomas'), false) else shown end
  union all select section, 'experiences', page, text, 0 from s where case when blocks >= 3 then block = 2 and shown when blocks = 2 then block = 1 and shown when coalesce(e, false) then coalesce(class = 'certificados', false) when coalesce(a, false) then coalesce(class = 'anexo16', false) else shown end)
select section, kind, md5(left(string_agg(text, chr(10) || chr(10) order by rank, page), 3000)) as digest from k group by 1, 2""")
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents a section, in one, two or three blocks; texts of at most 3,000 characters."""
    d = read(spark, sf_dir, "documents").select(F.expr("doc_id div 6").alias("section"), F.least(F.expr("doc_id % 6 div 2"), F.expr("doc_id div 6 % 3")).alias("block"), F.col("doc_id").alias("page"), "text")
    classes = (("anexo16", "@"), ("certificados", "[0-9]{4}"), ("diplomas", "[#|!]"))
    out = markdown.evidence_texts(d, ["section"], "block", "page", 3000, "@", "[#|!]", classes)
    return out.select("section", "kind", F.md5("text").alias("digest"))


# Jobs of tenders

_JOBS_SQL = """
j as (select o_orderkey as job, o_custkey as tender, case when o_orderkey % 3 = 0 then 'tdr' else 'extraction' end as kind, case when o_orderstatus = 'P' then 'error' else 'done' end as status, o_orderdate as ended from orders),
p as (select tender, max(case when kind = 'extraction' and status = 'done' then {'t': ended, 'j': job} end)['j'] as extraction_job, max(case when kind = 'tdr' and status = 'done' then {'t': ended, 'j': job} end)['j'] as requirement_job from j group by 1),
r as (select *, case when extraction_job is null then 'no extraction' when requirement_job is null then 'no tdr' else 'ready' end as state from p)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of customers: an extraction's sections are the order's lines, each with an experience or, of odd ones, two; a requirement job
    asks for a role."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("tender"), F.when(F.col("o_orderkey") % 3 == 0, "tdr").otherwise("extraction").alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("done").alias("status"), F.col("o_orderdate").alias("ended"), "o_orderpriority",
    )
    key, line, ship = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    day = F.when(line % 3 == 0, F.concat(F.lit('"fecha_inicio": "x", "fecha_inicio_parsed": "'), F.date_format(ship, "yyyy-MM-dd"), F.lit('"'))).when(line % 3 == 1, F.concat(F.lit('"fecha_inicio": "'), F.date_format(ship, "dd/MM/yyyy"), F.lit('", "fecha_inicio_parsed": null'))).otherwise('"fecha_inicio": "a la fecha"')
    exp = F.concat(F.lit('{"proyecto": "P'), F.col("l_partkey").cast("string"), F.lit('", '), day, F.lit("}"))
    person = F.when(line % 4 == 0, "null").when(line % 4 == 1, '{"nombre": "", "dni": "1"}').otherwise(F.concat(F.lit('{"nombre": "N'), F.col("l_suppkey").cast("string"), F.lit('", "profesion": "Civil"}')))
    section = F.concat(F.lit('{"cargo": "Jefe '), line.cast("string"), F.lit('", "profesional": '), person, F.lit(', "experiencias": ['), F.when(line % 2 == 1, F.concat(exp, F.lit(", "), exp)).otherwise(exp), F.lit("]}"))
    sections = read(spark, sf_dir, "lineitem").groupBy(key.alias("job")).agg(F.array_join(F.sort_array(F.collect_list(section)), ", ").alias("sections"))
    made = F.when(F.col("kind") == "tdr", F.concat(F.lit('{"rtm_personal": [{"cargo": "'), "o_orderpriority", F.lit('"}]}'))).otherwise(F.concat(F.lit('{"secciones": ['), F.coalesce("sections", F.lit("")), F.lit("]}")))
    return o.join(sections, "job", "left").withColumn("result", F.try_parse_json(made)).drop("o_orderpriority", "sections")


@query(f"with {_JOBS_SQL} select tender, extraction_job, requirement_job, state from r")
def job_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.pair_jobs(_jobs(spark, sf_dir).drop("result"), "tender", "job", "kind", "status", "ended")


@query(f"""
with {_JOBS_SQL}
select tender, 'Jefe ' || l_linenumber as role, case when l_linenumber % 4 in (0, 1) then '(sin nombre - Jefe ' || l_linenumber || ')' else 'N' || l_suppkey end as name, case when l_linenumber % 4 = 1 then '1' end as dni, 'P' || l_partkey as project_name,
  case when l_linenumber % 3 in (0, 1) then l_shipdate::date end as start_date, o_orderpriority as required, count(*) * case when l_linenumber % 2 = 1 then 2 else 1 end as n
from r join lineitem on l_orderkey = extraction_job join orders on o_orderkey = requirement_job where state = 'ready' group by tender, l_linenumber, l_suppkey, l_partkey, l_shipdate, o_orderpriority""")
def paired_experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = stored(_jobs(spark, sf_dir), "jobs")
    people, experiences_, asked = intake.evaluation_inputs(jobs, intake.pair_jobs(jobs, "tender", "job", "kind", "status", "ended"), "tender", "job", "result")
    rows = experiences_.drop("role", "dni", "name").join(people.select("tender", "section", "role", "name", "dni"), ["tender", "section"]).join(asked.select("tender", F.col("requirement.role").alias("required")), "tender")
    return rows.groupBy("tender", "role", "name", "dni", "project_name", "start_date", "required").agg(F.count(F.lit(1)).alias("n"))


# The whole curation

AREAS = ("Suelos", "Costos", "Estructuras", "Arquitectura", "Seguridad", "Calidad", "Geologia", "Puentes", "Sanitarias", "Comunicaciones", "Modelador", "Riego")

_PEOPLE_SQL = f"""
p as (select p_partkey as k, p_partkey // 12 as doc, p_partkey % 12 + 1 as n, {list(AREAS)}[1 + p_partkey % 12] as area, p_size as size from part),
a as (select *, case n when 11 then 'Modelador BIM' when 12 then 'Asistente de Riego' else 'Especialista en ' || area end as role,
  case when k % 5 = 0 then ['Ingeniero Civil', 'Ingeniero de ' || area] when k % 5 = 1 then ['Arquitecto'] when k % 5 = 2 then [] else ['Ingeniero Civil'] end as titles,
  case when k % 4 = 3 then ['Jefe de Obra'] else [] end as roles, case when k % 6 = 0 then null when k % 10 = 0 then size + 5 else size end as months, case when k % 10 = 0 then 'obra larga' when k % 3 = 0 then 'obra' end as work,
  case k % 4 when 0 then '48 meses' when 1 then 'N meses' when 2 then '3 meses (contabilizada desde la emision)' end as registered from p),
l as (select doc, n, ['Literal ' || n] as titles, 'literal' as work, 99 as months, 'Lectura ' || n as role from p where k % 4 = 1 union all select doc, 20, ['Literal 20'], 'literal', 99, 'Especialista en Tuneles' from p where n = 1 and doc % 3 = 0),
b as (select coalesce(a.doc, l.doc) as doc, coalesce(a.n, l.n) as n, coalesce(a.role, l.role) as role, coalesce(l.titles, a.titles) as titles, a.roles, coalesce(a.months, l.months) as months, coalesce(l.work, a.work) as work, a.registered,
  case when l.n is null then 'text' when a.n is null then 'structured' else 'both' end as source, k, area from a full join l on a.doc = l.doc and a.n = l.n),
v as (select doc, n, role, case when k % 4 = 2 and n <= 10 and area <> 'Arquitectura' then ['Ingeniero Visual'] when k % 4 = 2 then ['Ingeniero Visual'] else titles end as titles, coalesce(roles, []) as roles, coalesce(months, case when k % 4 = 2 then 7 end) as months,
  coalesce(work, case when k % 4 = 2 then 'visual' end) as work, registered, source, area, k from b),
t as (select *, case when k % 3 = 0 and not (source <> 'text' and len(titles) > 0) then list_filter(['Ingeniero Civil', 'arquitecto'] || titles, lambda x, i: not x like 'Ingeniero de %' and not x like 'Literal%' and not list_contains(list_transform((['Ingeniero Civil', 'arquitecto'] || titles)[1:i - 1], lambda y: lower(y)), lower(x))) else titles end as united from v),
s as (select *, case when source = 'text' and (len(united) > 0 or len(roles) > 0) then array_to_string(list_sort(united), ',') || '|' || array_to_string(roles, ',') end as signature from t),
w as (select *, signature is not null and count(*) over (partition by doc, signature) >= 2 as needs_review from s),
h as (select doc, n, role, united as titles, roles, months, work, registered, needs_review, case when n = 3 then 40 end as hours from w union all select doc, null, 'otro cargo', [], [], null, null, null, false, 8 from p where n = 1 and doc % 4 = 1),
c as (select * exclude registered, case registered when '48 meses' then case when months > 0 and months < 48 then months::varchar else '48 meses' end when 'N meses' then null when '3 meses (contabilizada desde la emision)' then case when months > 0 and months < 3 then months::varchar else '3 meses' end end as registered from h),
d as (select * from c where role not in ('Modelador BIM', 'Asistente de Riego')),
f as (select *, case when role like 'Especialista en %' then 'por meses' when doc % 2 = 0 then 'Hasta 5 puntos' end as factor from d),
z as (select * from f where (role <> '')::int + (len(titles) > 0)::int + (len(roles) > 0)::int + (months is not null)::int + (work is not null)::int + (registered is not null)::int + (hours is not null)::int + (factor is not null)::int > 1)"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Twelve parts a document: rows some of which come twice, or without the number that stands in the text; literal and visual reads, further titles, training and
    factors for some."""
    k = F.col("k")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 12").alias("doc"), (F.col("p_partkey") % 12 + 1).alias("n"), _pick(AREAS, F.col("p_partkey") % 12).alias("area"), F.col("p_size").alias("size"))
    none = F.array().cast("array<string>")
    role = F.when(F.col("n") == 11, "Modelador BIM").when(F.col("n") == 12, "Asistente de Riego").otherwise(F.concat(F.lit("Especialista en "), "area"))
    made = F.concat(F.lit("Ingeniero de "), "area")
    titles = F.when(k % 5 == 0, F.array(F.lit("Ingeniero Civil"), made)).when(k % 5 == 1, F.array(F.lit("Arquitecto"))).when(k % 5 == 2, none).otherwise(F.array(F.lit("Ingeniero Civil")))
    registered = F.when(k % 4 == 0, "48 meses").when(k % 4 == 1, "N meses").when(k % 4 == 2, "3 meses (contabilizada desde la emision)")
    rows = p.select(
        "k", "doc", F.when(k % 7 != 0, F.col("n")).alias("number"), role.alias("role"), titles.alias("titles"), F.when(k % 4 == 3, F.array(F.lit("Jefe de Obra"))).otherwise(none).alias("roles"), F.when(k % 6 != 0, F.col("size")).alias("months"),
        F.when(k % 3 == 0, "obra").alias("work"), registered.alias("registered"),
    )
    longer = rows.where("k % 10 = 0").withColumns({"titles": F.slice("titles", 1, 1), "months": F.col("months") + 5, "work": F.lit("obra larga"), "registered": F.lit(None).cast("string"), "number": F.lit(None).cast("long")})
    rows = rows.unionByName(longer).drop("k")
    nothing = F.lit(None).cast("string")
    literal = p.where("k % 4 = 1").select("doc", F.col("n").alias("number"), F.concat(F.lit("Lectura "), F.col("n").cast("string")).alias("role"), F.array(F.concat(F.lit("Literal "), F.col("n").cast("string"))).alias("titles"))
    more = p.where("n = 1 and doc % 3 = 0").select("doc", F.lit(20).cast("long").alias("number"), F.lit("Especialista en Tuneles").alias("role"), F.array(F.lit("Literal 20")).alias("titles"))
    literal = literal.unionByName(more).withColumns({"roles": none, "months": F.lit(99), "work": F.lit("literal"), "registered": nothing})
    visual = p.where("k % 4 = 2").select("doc", F.col("n").alias("number"), F.array(F.lit("Ingeniero Visual")).alias("titles"), none.alias("roles"), F.lit(7).alias("months"), F.lit("visual").alias("work"))
    titles = p.where("k % 3 = 0").select("doc", F.col("n").alias("number"), F.array(F.lit("Ingeniero Civil"), F.lit("arquitecto"), F.lit("Xyz"), made).alias("titles"))
    training = p.where("n = 3").select("doc", role.alias("role"), F.lit(40).alias("hours")).unionByName(p.where("n = 1 and doc % 4 = 1").select("doc", F.lit("Otro Cargo").alias("role"), F.lit(8).alias("hours")))
    factors = p.where("n = 2").select("doc", F.lit(1).alias("position"), role.alias("factor_role"), F.lit("por meses").alias("method"), F.lit(0).alias("points"))
    factors = factors.unionByName(p.where("n = 1 and doc % 2 = 0").select("doc", F.lit(2).alias("position"), F.lit("Consultoria general").alias("factor_role"), nothing.alias("method"), F.lit(5).alias("points")))
    texts = p.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), F.upper("area"), F.lit(" ;")))), "\n").alias("text"))
    return rows, literal, visual, titles, training, factors, texts


@query(f"""
with {_PEOPLE_SQL}
select doc, n as number, role, array_to_string(titles, '|') as titles, array_to_string(roles, '|') as roles, months::int as months, work, registered, hours::int as hours, factor, needs_review,
  row_number() over (partition by doc order by case when n between 1 and 30 then n else 99 end, n nulls last, role)::int as row from z""")
def curated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curate.curate_people(*_people(spark, sf_dir))
    return out.select("doc", "number", "role", F.array_join("titles", "|").alias("titles"), F.array_join("roles", "|").alias("roles"), F.col("months").cast("int").alias("months"), "work", "registered", "hours", "factor", "needs_review", "row")


# Fields of texts

#: Per field: what it is read from, and the text of what it has to be; {k} is the row's key.
FIELDS = {
    "role_number": (("Especialista N° 3", "3"), ("Jefe n°2 N° 12", "12"), ("Residente", None), ("N°{k} Gestor", "{k}")),
    "clean_role": (("Especialista N° 3", "Especialista"), ("Jefe n°2 N° 12", "Jefe"), ("Residente {k}", "Residente {k}")),
    "numeric_anchor": (("3. JEFE", "3"), ("N° 12) X", "12"), ("31. X", None), ("x 3. Y", None), ("07- Z", "7"), ("0. W", None)),
    "near_roles": (("1 JEFE\n 2. especialista, 45 jefe", "1,2"), ("nothing {k}", ""), ("7) residente | 7 Supervisor", "7")),
    "table_items": (("| 1 | a |\n| x | b |\n  | 22 | c |", "2"), ("1 | a", "0"), ("|{k}|", "1")),
    "speciality": (("Asistente de Suelos", "Suelos"), ("Especialista en Costos {k}", "Costos {k}"), ("Jefe de Obra", None)),
    "fixed": (("Ingeniero Eléctricc y/0 Otro", "Ingeniero Eléctrico y/o Otro"), ("Civil  y/o  Mecanico", "Civil y/o Mecanico"), ("plain {k}", "plain {k}")),
    "split_titles": (("Ingeniero Civil y/o Arquitecto", "Ingeniero Civil;Arquitecto"), ("ingeniero civil, Ingeniero Civil, Jefe", "ingeniero civil"), ("Jefe {k}", "")),
    "similar_roles": (("Jefe de Obra y/o Residente en obras de salud", "Jefe de Obra;Residente"), ("abc y/o Gestor {k}", "Gestor {k}"), ("", "")),
    "months": (("Experiencia de (24) meses", "24"), ("12 meses, (36) meses", "36"), ("{k} meses", "{k}"), ("dos meses", None)),
    "number": (("1,234.5", "1234.5"), (" 7 ", "7.0"), ("x", None), ("", None)),
    "leading": (("abc 12 de 30", "12"), ("ninguno", None), ("un texto demasiado largo para un numero 5", None)),
    "duration": (("48 meses (contabilizada desde la emisión del grado)", "48 meses"), ("N meses", None), ("Título profesional: 12 meses", "12 meses"), ("{k} meses (todos)", "{k} meses (todos)")),
    "suspicious": (("CIP 1234567", "true"), ("CAP 12-345", "false"), ("12345-67", "true"), (None, "false")),
    "same_group": (("especialista bim", "true"), ("gestor bim", "true"), ("jefe de supervision", "false"), ("topografo", "false")),
    "null_word": (("None", None), (" null ", None), ("nulls {k}", "nulls {k}"), ("", None)),
    "real_title": (("Ingeniero Civil", "true"), ("Tecnico {k}", "true"), ("Jefe de Obra", "false"), ("civil", "false")),
    "period": (("22.05.2017 al 31.12.2019", "2017-05-22/2019-12-31"), ("01/ENE/2018 hasta el 15.03.2020", "2018-01-01/2020-03-15"), ("10 de enero del 2023", "2023-01-10/")),
    "iso_day": (("2023-01-15T10:00", "2023-01-15"), ("15.03.2020", "2020-03-15"), ("a la fecha", None)),
}


def _fields_sql() -> str:
    quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    wanted = lambda pairs: "[" + ", ".join(quoted(b) for _, b in pairs) + "]"
    return "select p_partkey, " + ", ".join(f"replace({wanted(pairs)}[1 + p_partkey % {len(pairs)}], '{{k}}', (p_partkey % 900 + 100)::varchar) as {name}" for name, pairs in FIELDS.items()) + " from part"


@query(_fields_sql())
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the helpers read from texts of each kind, for each part; keys in texts are of three digits."""
    key = (F.col("p_partkey") % 900 + 100).cast("string")
    given = {n: F.replace(F.get(F.array(*(F.lit(a).cast("string") for a, _ in pairs)), (F.col("p_partkey") % len(pairs)).cast("int")), F.lit("{k}"), key).alias(n) for n, pairs in FIELDS.items()}
    parts = read(spark, sf_dir, "part").select("p_partkey", *given.values())
    t = stored(parts.drop("p_partkey").distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts")  # equal texts are read once
    t = records.null_words_to_null(t.withColumnRenamed("null_word", "kept")).select("text_id", F.col("kept").alias("null_word")).join(t.withColumnRenamed("null_word", "asked"), "text_id")
    t = records.flag_suspicious_id(t.withColumn("id", F.col("suspicious")), "id")
    c, joined = F.col, lambda a: F.array_join(a, ";")
    period = dates.split_period(c("period"))
    made = {
        "role_number": text.role_number(c("role_number")), "clean_role": text.clean_role(c("clean_role")), "numeric_anchor": text.numeric_anchor(c("numeric_anchor")), "near_roles": F.array_join(F.array_sort(text.numbers_near_roles(c("near_roles"))).cast("array<string>"), ","),
        "table_items": pages.count_table_items(c("table_items")), "speciality": text.speciality_of_role(c("speciality")), "fixed": text.fix_ocr_typos(c("fixed")), "split_titles": joined(text.split_titles(c("split_titles"))),
        "similar_roles": joined(text.split_similar_roles(c("similar_roles"))), "months": dates.parse_months(c("months")), "number": records.to_float(c("number")), "leading": records.leading_int(c("leading")), "duration": records.clean_duration(c("duration")),
        "suspicious": c("needs_review"), "same_group": similarity.same_synonym_group(c("same_group"), F.lit("Coordinador BIM")), "null_word": c("null_word"), "real_title": requirements.is_title(c("real_title")),
        "period": F.concat(period["start"].cast("string"), F.lit("/"), F.coalesce(period["end"].cast("string"), F.lit(""))), "iso_day": dates.iso_or_spanish(c("iso_day")),
    }
    told = t.select(*(F.col("asked" if n == "null_word" else n).alias(f"__{n}") for n in FIELDS), *(v.cast("string").alias(n) for n, v in made.items()))
    told = stored(told, "fields")
    same = reduce(lambda a, b: a & b, (F.col(f"p.{n}").eqNullSafe(F.col(f"t.__{n}")) for n in FIELDS))
    return parts.alias("p").join(told.alias("t"), same).select("p_partkey", *(F.col(f"t.{n}") for n in made))


# Sources

_BODY_SQL = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[`\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dumps of three pages: the text in a fence with an engine and a confidence, a bare page, a fence with a language."""
    d, c = read(spark, sf_dir, "documents"), F.concat
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[`\s]+", " "))
    dump = c(F.lit("index\n## Página 1  _paddle · conf 0."), (F.col("doc_id") % 10).cast("string"), F.lit("5_\n\n```\n"), body, F.lit("\n```\nafter\n--- Página 2 ---\n  bare "), F.coalesce("source", F.lit("")), F.lit(" \n\n## Pagina 12  _x_\n```text\n"), F.coalesce("lang", F.lit("")), F.lit("\n```\n"))
    return d.select("doc_id", dump.alias("dump"))


@query(f"""
select doc_id, 1 as page_num, '0.' || doc_id % 10 || '5' as confidence, md5({_BODY_SQL}) as digest, true as fenced from documents
union all select doc_id, 2, null, md5(trim('bare ' || coalesce(source, ''))), false from documents union all select doc_id, 12, null, md5(coalesce(lang, '')), true from documents""")
def paged_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = stored(_dumps(spark, sf_dir), "dumps")
    strict = readers.read_page_results(dumps, strict=True).select("doc_id", "page_num", F.lit(True).alias("fenced"))
    out = readers.read_page_results(dumps).join(strict, ["doc_id", "page_num"], "left")
    return out.select("doc_id", "page_num", F.format_number("confidence", 2).alias("confidence"), F.md5("text").alias("digest"), F.coalesce("fenced", F.lit(False)).alias("fenced"))


@query("""
with r as (select event_id, event_type, value, unnest(range(case when event_id % 5 in (0, 1, 2) then 2 when event_id % 5 = 3 then 1 else 0 end)) as position from events)
select event_id, position::int as position, case when position = 0 then event_type else 'second' end as name, case when position = 0 then event_id else null end as id, case when position = 1 then round(value, 2)::double end as amount from r""")
def child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are a list, hold one under a key, are one object, or no JSON; records with other names of a field, or without it."""
    e = read(spark, sf_dir, "events")
    first = F.concat(F.lit('{"Nombre": "'), "event_type", F.lit('", "id": "'), F.col("event_id").cast("string"), F.lit('", "monto": "x"}'))
    second = F.concat(F.lit('{"nombre": "second", "Id": null, "importe": '), F.round("value", 2).cast("string"), F.lit("}"))
    both, k = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]")), F.col("event_id") % 5
    answer = F.when(k == 0, both).when(k == 1, F.concat(F.lit('{"Result": '), both, F.lit("}"))).when(k == 2, F.concat(F.lit('{"n": 2, "obras": '), both, F.lit("}"))).when(k == 3, first).otherwise("<html>")
    rows = readers.normalize_envelope(e.select("event_id", answer.alias("answer")), "answer").where("record is not null")
    spec = {"name": ("string", ("Nombre", "nombre")), "id": ("long", ("id", "Id")), "amount": ("double", ("monto", "importe"))}
    return readers.type_child_records(rows.select("event_id", "position", F.struct("event_id", "position").alias("key"), F.col("record").cast("string").alias("record")), "key", spec).select("key.*", "name", "id", "amount")


@query("""
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) + 1 as i from lineitem)
select l_orderkey as sheet, i::bigint as i, l_partkey::varchar as part, l_suppkey::varchar as col_2, case when l_linenumber % 2 = 0 then 'x' end as last, (count(*) over (partition by l_orderkey) + 3)::bigint as rows, 3 as columns, (count(*) over (partition by l_orderkey) + 1)::bigint as filled from r""")
def sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: an empty row, a header with a blank, the lines, an empty row."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = curate.number_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in order], "i")
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"))
    body = lines.select(F.col("l_orderkey").alias("sheet"), (F.col("i") + 1).cast("long").alias("i"), F.array(text("l_partkey"), text("l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, "x ")).alias("cells"))
    sheets = lines.select(F.col("l_orderkey").alias("sheet")).distinct()
    row = lambda i, *cells: sheets.select("sheet", F.lit(i).cast("long").alias("i"), F.array(*(F.lit(x).cast("string") for x in cells)).alias("cells"))
    rows = body.unionByName(row(0, None, " ", "")).unionByName(row(1, "Part ", None, "Last")).unionByName(row(10_000, "", None, None))
    told = readers.sheet_profile(rows, ["sheet"], "cells").select("sheet", "rows", "columns", F.col("filled_rows").alias("filled"))
    out = readers.promote_header(rows, ["sheet"], "i", "cells").join(told, "sheet")
    return out.select("sheet", "i", F.col("record")["Part"].alias("part"), F.col("record")["Col_2"].alias("col_2"), F.col("record")["Last"].alias("last"), "rows", "columns", "filled")


@query("""
select event_type as block_type, count(*) as calls, count(*) filter (value <= 20) as failed, sum(event_id % 100 + user_id % 7)::bigint as tokens, round(sum(user_id % 7) / sum(value / 100), 2)::double as tokens_a_second,
  case when round(sum(user_id % 7) / sum(value / 100), 2) > 200 then 'GPU' else 'CPU' end as device from events group by 1""")
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("block_type"), (F.col("value") > 20).alias("ok"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("user_id") % 7).alias("answer_tokens"), (F.col("value") / 100).alias("seconds"))
    return readers.call_metrics(calls)


@query("""
select source, count(*) as pages, count(*) filter (contains(text, '#') or contains(text, '@')) as scored, count(*) filter (contains(text, '@')) as selected from documents group by 1""")
def scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lambda x: F.when(F.contains("text", F.lit(x)), 1.0).otherwise(0.0)
    d = read(spark, sf_dir, "documents").withColumns({"a": there("#"), "b": there("@")})
    return report.scoring_summary(d, ["a", "b"], F.col("b") > 0, ["source"])


# Sources accepted, persons verified

_LAYERS_SQL = """
r as (select p_partkey // 40 as doc, ['grid', 'image', 'lines'][1 + p_partkey % 3] as source, 10 + (p_partkey // 40) % 7 as expected, (p_partkey % 4 > 0)::int as t, (p_partkey % (2 + p_partkey // 40 % 3) > 0)::int as o from part),
a as (select doc, source, count(*) as rows, max(expected) as expected, avg(t) as with_titles, avg(o) as with_roles from r group by 1, 2), b as (select *, rows >= 0.8 * expected and greatest(with_titles, with_roles) >= 0.7 as accepted from a)"""


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, doc = F.col("p_partkey"), F.expr("p_partkey div 40")
    some = lambda c: F.when(c, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf_dir, "part").select(k.alias("k"), doc.alias("doc"), _pick(("grid", "image", "lines"), k % 3).alias("source"), (doc % 7 + 10).alias("expected"), some(k % 4 > 0).alias("titles"), some(k % (doc % 3 + 2) > 0).alias("roles"))
    return rows, merge.accept_source(rows, "doc", "source", "expected", "titles", "roles")


@query(f"with {_LAYERS_SQL} select doc, source, rows, expected, round(with_titles, 6)::double as with_titles, round(with_roles, 6)::double as with_roles, accepted from b")
def accepted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, accepted = _layers(spark, sf_dir)
    return accepted.withColumns({c: F.round(c, 6) for c in ("with_titles", "with_roles")})


@query(f"""
with {_LAYERS_SQL}, f as (select doc, arg_min(source, case source when 'lines' then 1 when 'grid' then 2 else 3 end) as source from b where accepted group by 1)
select doc, source, count(*) as n from r join f using (doc, source) group by 1, 2""")
def first_accepted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, accepted = _layers(spark, sf_dir)
    return merge.first_accepted_source(rows, accepted, "doc", "source", ["lines", "grid", "image"]).groupBy("doc", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""
with n as (select count(*) as n from part),
p as (select p_partkey // 10 as work, p_name || ' ' || p_brand as person, date '1992-01-01' + p_size * 60 as s, case when p_partkey % 5 > 0 then date '1992-01-01' + p_size * 60 + 400 end as e from part),
c as (select o_orderkey as cert, (o_orderkey % n) // 10 as work, case o_orderkey % 3 when 0 then p_brand || ', ' || upper(p_name) when 1 then p_name else 'Somebody Else' end as name, o_orderdate::date as s, o_orderdate::date + 30 as e from orders, n, part where p_partkey = o_orderkey % n),
t as (select *, list_filter(list_distinct(string_split(regexp_replace(upper(name), '[^A-Z0-9 ]', ' ', 'g'), ' ')), lambda x: x <> '') as a from c),
u as (select *, list_filter(list_distinct(string_split(regexp_replace(upper(person), '[^A-Z0-9 ]', ' ', 'g'), ' ')), lambda x: x <> '') as b from p),
m as (select cert, person, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as score, t.s <= coalesce(u.e, t.e) and u.s <= t.e as meets from t join u using (work)),
r as (select *, row_number() over (partition by cert order by score desc, meets desc, person desc) as i from m)
select cert, person, round(score, 6)::double as name_score, score >= 0.6 as matched, case when score >= 0.6 then meets end as period_ok from r where i = 1""")
def verified_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates with their person's name in another order, in part, or another's, against ten registered persons a work."""
    part, n = read(spark, sf_dir, "part"), read(spark, sf_dir, "part").count()
    begin = F.date_add(F.lit("1992-01-01").cast("date"), F.col("p_size") * 60)
    people = part.select(F.expr("p_partkey div 10").alias("work"), F.concat_ws(" ", "p_name", "p_brand").alias("person"), begin.alias("p_start"), F.when(F.col("p_partkey") % 5 > 0, F.date_add(begin, 400)).alias("p_end"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    name = F.when(key % 3 == 0, F.concat("p_brand", F.lit(", "), F.upper("p_name"))).when(key % 3 == 1, F.col("p_name")).otherwise("Somebody Else")
    certs = read(spark, sf_dir, "orders").join(part, F.col("p_partkey") == key % n).select(key.alias("cert"), F.expr("p_partkey div 10").alias("work"), name.alias("name"), day.alias("start"), F.date_add(day, 30).alias("end"))
    return works.verify_person(certs, people, "work", "cert")


@query(f"""
select person, experience, {", ".join(f"case when {c} in ('SI', 'CUMPLE') then 'green' when {c} in ('NO', 'NO CUMPLE') then 'red' when {c} = 'NO EVALUABLE' then 'yellow' end as {c}" for c in ("title_ok", "role_ok", "sector_ok", "action_ok", "complexity"))}
from ({ORACLES["evaluation_table"]})""")
def status_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_table(spark, sf_dir).select("person", "experience", *(evaluate.status_colour(F.col(c)).alias(c) for c in ("title_ok", "role_ok", "sector_ok", "action_ok", "complexity")))


@query("""
select p_partkey, trim(case when p_partkey % 3 = 0 then '' else p_name || ' ' end || case when p_partkey % 4 = 0 then '' else p_brand || ' ' end || p_type) as name from part""")
def full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = F.when(k % 3 != 0, F.concat(F.lit(" "), "p_name")), F.when(k % 4 == 0, " ").otherwise(F.col("p_brand")), F.concat("p_type", F.lit("  "))
    return read(spark, sf_dir, "part").select("p_partkey", curate.full_name(*parts).alias("name"))
