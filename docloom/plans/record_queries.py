"""Queries of consensus, linkage, validation, records and views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import loose_date
from ..functions.quality import text_quality
from ..operators import records as R
from ..operators import validation as V
from ..operators import views as X
from ..operators.consensus import aligned_rows, best_text, cell_vote, engine_weight, list_union, vote
from ..operators.linkage import canonical_match, match_training, training_options
from ..operators.processing import shared_details as details_of
from ..operators.processing import with_fallback
from ..sources.files import unique_content
from ..shared import spread
from .common import sql_clean, sql_edit_ratio, sql_normalize, sql_overlap, sql_tokens, sql_weight, table

ENGINES = ("TABLA_TEXTUAL", "DIGITAL_LINEAL", "OCR_TEXTO")


# --- plain scans and key figures ---


def scan_project(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'FURNITURE'").select("c_custkey", "c_name", "c_acctbal")


SCAN_PROJECT = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE'"


def file_hash_dedup(spark, d):
    return unique_content(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


FILE_HASH_DEDUP = "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


def _statuses(spark, d):
    """Orders as records with a status and a list of items."""
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'COMPLETO' WHEN 'O' THEN 'REVISAR' WHEN 'P' THEN 'ERROR' ELSE 'NO_ES_PLAN' END")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", status.alias("status"), F.expr("sequence(1, cast(o_orderkey % 4 + 1 as int))").alias("items"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETO' WHEN 'O' THEN 'REVISAR' WHEN 'P' THEN 'ERROR' ELSE 'NO_ES_PLAN' END"


def search_filter(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # one row for each nation
    c = c.withColumn("status", F.when(F.col("c_acctbal") < 0, "ERROR").when(F.col("c_acctbal") < 1000, "REVISAR").otherwise("COMPLETO"))
    return X.search(c, " Nation_1 furn", ["c_name", "n_name", "c_mktsegment"], "REVISAR").select("c_custkey", "n_name")


SEARCH_FILTER = """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name || ' ' || n_name || ' ' || c_mktsegment), 'nation_1 furn') AND c_acctbal >= 0 AND c_acctbal < 1000"""


def status_label(spark, d):
    rows = _statuses(spark, d).withColumn("state", F.when(F.col("o_orderkey") % 3 == 0, "FIRMADO").when(F.col("o_orderkey") % 3 == 1, "ANULADO").otherwise("GENERADO"))
    return rows.select("o_orderkey", X.status_label(F.col("status")).alias("label"), X.state_class(F.col("state")).alias("class"))


STATUS_LABEL = f"""SELECT o_orderkey, CASE {_STATUS} WHEN 'COMPLETO' THEN 'Completo' WHEN 'REVISAR' THEN 'Revisar' ELSE 'Error' END AS label,
 CASE o_orderkey % 3 WHEN 0 THEN 'signed' WHEN 1 THEN 'cancelled' ELSE 'pending' END AS class FROM orders"""


def kpi_summary(spark, d):
    return X.summary(_statuses(spark, d), "items", {"urgent": F.col("o_orderpriority").startswith("1")})


KPI_SUMMARY = f"""SELECT count(*) AS total, count(*) FILTER (s = 'COMPLETO') AS complete, count(*) FILTER (s = 'REVISAR') AS review, count(*) FILTER (s IN ('ERROR', 'NO_ES_PLAN')) AS failed,
 sum(o_orderkey % 4 + 1)::BIGINT AS items, count(*) FILTER (starts_with(o_orderpriority, '1')) AS urgent FROM (SELECT *, {_STATUS} AS s FROM orders)"""


def kpi_review_tile(spark, d):
    return X.review_tile(X.summary(_statuses(spark, d))).select("total", "review_tile")


KPI_REVIEW_TILE = f"SELECT count(*) AS total, count(*) FILTER ({_STATUS} <> 'COMPLETO') AS review_tile FROM orders"


# --- consensus: customers as three engines read them ---

_READ = """CASE engine_idx WHEN 0 THEN c_name || ' ' || c_mktsegment
 WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN upper(c_name || ' ' || c_mktsegment) WHEN c_custkey % 3 = 1 THEN c_name || '  ' || c_mktsegment || '.' ELSE 'Total de horas ' || c_name END
 ELSE CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'Total de horas ' || c_name ELSE c_name END END"""


def _engine_rows(spark, d):
    c = spread(table(spark, d, "customer")).select("c_custkey", "c_name", "c_mktsegment", F.posexplode(F.array(*map(F.lit, ENGINES))).alias("engine_idx", "engine"))
    rows = c.select("c_custkey", "engine_idx", "engine", F.expr(_READ).alias("value"))
    return rows.withColumn("quality", text_quality("value"))


_SQL_ENGINES = f"""r AS (SELECT c_custkey, engine_idx, engine, {_READ} AS value FROM customer, (VALUES (0, 'TABLA_TEXTUAL'), (1, 'DIGITAL_LINEAL'), (2, 'OCR_TEXTO')) e(engine_idx, engine)),
q AS (SELECT *, CASE WHEN value = '' THEN -1000 ELSE least(24, ceil(length(v) / 10.0)) - CASE WHEN contains(' ' || k || ' ', ' total de horas ') THEN 80 ELSE 0 END END AS quality
 FROM (SELECT c_custkey, engine_idx, engine, value, {sql_clean('value')} AS v, {sql_normalize('value')} AS k, {sql_weight('engine')} AS w FROM r))"""


def consensus_scalar_vote(spark, d):
    return vote(_engine_rows(spark, d), ["c_custkey"])


CONSENSUS_SCALAR_VOTE = f"""WITH {_SQL_ENGINES},
p AS (SELECT *, round(greatest(0.1, w + greatest(-4.0, least(8.0, quality / 10.0))), 6)::DOUBLE AS points FROM q WHERE k <> ''),
g AS (SELECT c_custkey, k, sum(points) AS points, min(engine_idx) AS first, count(*) AS votes, arg_max(v, quality * 1000 - engine_idx) AS value, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines FROM p GROUP BY c_custkey, k),
s AS (SELECT *, sum(points) OVER (PARTITION BY c_custkey) AS total, row_number() OVER (PARTITION BY c_custkey ORDER BY round(points, 6) DESC, first) AS r FROM g)
SELECT c_custkey, value, round(points, 4) AS points, least(100, floor(55 + points / greatest(1.0, total) * 35 + least(10, votes * 3) + 0.5))::INTEGER AS confidence, votes, engines FROM s WHERE r = 1"""


def cell_vote_query(spark, d):
    return cell_vote(_engine_rows(spark, d), ["c_custkey"])


CELL_VOTE = f"""WITH {_SQL_ENGINES},
g AS (SELECT c_custkey, k, sum(w)::BIGINT AS points, min(engine_idx) AS first, arg_min(v, engine_idx) AS value FROM q WHERE k <> '' GROUP BY c_custkey, k)
SELECT c_custkey, value, points FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY points DESC, first) AS r FROM g) WHERE r = 1"""


def best_text_query(spark, d):
    return best_text(_engine_rows(spark, d), ["c_custkey"]).withColumn("points", F.round("points", 4))


BEST_TEXT = f"""WITH {_SQL_ENGINES},
p AS (SELECT *, round(w + greatest(-5.0, least(12.0, quality / 5.0)), 6)::DOUBLE AS points FROM q WHERE v <> '')
SELECT c_custkey, v AS value, round(points, 4) AS points FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY points DESC, length(v) DESC, engine_idx) AS r FROM p) WHERE r = 1"""


def list_union_distinct(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"))
    return list_union(p, ["p_brand"])


LIST_UNION_DISTINCT = f"""WITH p AS (SELECT p_brand, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS value FROM part),
f AS (SELECT p_brand, {sql_normalize('value')} AS k, min(ord) AS ord, arg_min(value, ord) AS value FROM p GROUP BY ALL)
SELECT p_brand, value, (row_number() OVER (PARTITION BY p_brand ORDER BY ord, k) - 1)::INTEGER AS pos FROM f"""


def row_alignment(spark, d):
    """Rows of an order as three engines read them: one has them all, one misreads some, one loses some."""
    li = table(spark, d, "lineitem")  # line numbers repeat in an order; every row is one of its lines
    li = li.select("l_orderkey", "l_partkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("l_linenumber"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " "))).alias("name"))
    rows = li.join(names, "l_partkey").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", F.col("l_linenumber").alias("line"), "name", F.posexplode(F.array(*map(F.lit, ENGINES))).alias("engine_idx", "engine"))
    rows = rows.where(~((F.col("engine_idx") == 2) & (F.col("l_partkey") % 4 == 0)))
    name = F.when((F.col("engine_idx") == 1) & (F.col("l_partkey") % 3 == 0), F.regexp_replace("name", "widget", "w1dget")).otherwise(F.col("name"))
    out = rows.select("doc_id", "engine", "engine_idx", engine_weight("engine").alias("weight"), F.col("line").alias("ord"), name.alias("key"), name.alias("name"), (F.col("l_partkey") % 90).cast("double").alias("hours"), F.lit("2025").alias("start"), F.lit("2026").alias("end"), F.lit("curso").alias("kind"))
    return aligned_rows(out).select("doc_id", "engine", "ord", "slot", "name")


# --- linkage ---


def _agreements_and_options(spark, d):
    p = spread(table(spark, d, "part")).withColumn("words", F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " "), F.concat(F.lit("k"), (F.col("p_partkey") % 37).cast("string"))))
    period = F.concat(F.lit("20"), (F.col("p_size") + 10).cast("string"), F.lit("-01"))
    options = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").cast("string").alias("option_id"), F.col("p_partkey").alias("ordinal"), F.col("words").alias("teacher"), F.concat_ws(" ", "p_type", "p_name").alias("training"), period.alias("period"))
    records = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("record_id"), F.array_join(F.reverse(F.split("words", " ")), " ").alias("teacher"), F.concat_ws(" ", "p_name", "p_type").alias("training"), period.alias("period"))
    return records, options


def link_argmax(spark, d):
    return match_training(*_agreements_and_options(spark, d))


LINK_ARGMAX = f"""WITH p AS (SELECT *, p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ') || ' k' || (p_partkey % 37) AS words, '20' || (p_size + 10) || '-01' AS period FROM part),
o AS (SELECT p_partkey, {sql_tokens('words', 1)} AS b, {sql_tokens("p_type || ' ' || p_name", 1)} AS tb, period FROM p WHERE p_partkey % 7 = 0),
r AS (SELECT p_partkey, {sql_tokens('words', 1)} AS a, {sql_tokens("p_name || ' ' || p_type", 1)} AS ta, period FROM p WHERE p_partkey % 7 <> 0),
s AS (SELECT r.p_partkey AS record_id, o.p_partkey AS option_id, {sql_overlap('a', 'b')} AS st, {sql_overlap('ta', 'tb')} AS sc, CASE WHEN r.period = o.period THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS sp FROM r, o),
t AS (SELECT *, round(st * 0.55::DOUBLE + sc * 0.40::DOUBLE + sp, 6) AS score FROM s)
SELECT record_id, option_id::VARCHAR AS option_id, score FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, option_id) AS k FROM t) WHERE k = 1 AND st >= 0.65 AND sc >= 0.5 AND score >= 0.62"""


def options_flatten(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    plans = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").cast("string").alias("teacher"), F.col("o_orderpriority").alias("career"), F.lit("2025-01").alias("period"), F.transform("x", lambda t: F.struct(F.concat(F.lit("part "), t["l_partkey"].cast("string")).alias("name"))).alias("trainings"))
    return training_options(plans)


OPTIONS_FLATTEN = """SELECT o_orderkey || ':cap-' || k AS option_id, o_orderkey AS plan_id, o_custkey::VARCHAR AS teacher, o_orderpriority AS career, '2025-01' AS period, 'part ' || l_partkey AS training, k::INTEGER AS ordinal
FROM orders JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem) ON l_orderkey = o_orderkey"""

CAREERS = ["Ingeniería en Sistemas", "Administración de Empresas", "Enfermería", "Derecho", "Medicina Veterinaria", "Contabilidad y Auditoría"]
_CAREER = "element_at(array('ingenieria en sistemas', 'ADMINISTRACION DE EMPRESA', 'Enfermeria', 'Drecho', 'Medicina veterinarla', 'Contabilidad', 'Turismo'), cast(c_custkey % 7 + 1 as int))"


def canonical_dim_match(spark, d):
    return canonical_match(table(spark, d, "customer").select("c_custkey", F.expr(_CAREER).alias("name")), CAREERS)


CANONICAL_DIM_MATCH = f"""WITH n AS (SELECT c_custkey, ['ingenieria en sistemas', 'ADMINISTRACION DE EMPRESA', 'Enfermeria', 'Drecho', 'Medicina veterinarla', 'Contabilidad', 'Turismo'][c_custkey % 7 + 1] AS name FROM customer),
d AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(CAREERS))}) d(ord, canonical)),
s AS (SELECT c_custkey, name, canonical, ord, {sql_edit_ratio('a', 'b')} AS score FROM (SELECT *, {sql_normalize('name')} AS a, {sql_normalize('canonical')} AS b FROM n, d))
SELECT c_custkey, name, CASE WHEN score >= 0.88 THEN canonical ELSE name END AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, ord) AS r FROM s) WHERE r = 1"""


# --- validation: orders as plans, some of them damaged ---

AS_OF_YEAR = 2026
_PLAN = {
    "name": "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN repeat('nombre ', 30) ELSE 'Docente ' || o_custkey END",
    "career": "CASE WHEN o_orderkey % 13 = 0 THEN 'Total de horas 40' ELSE 'Derecho' END",
    "code": "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN 'UGPA-RGI1-00-PRO-251-2025-12' WHEN o_orderkey % 7 = 2 THEN 'X-1' ELSE 'UGPA-RGI1-44-PRO-251-2025-12' END",
    "period": "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '2025/12' WHEN o_orderkey % 5 = 2 THEN '2024-01' ELSE '2025-12' END",
    "template": "CASE WHEN o_orderkey % 3 = 0 THEN 'ANTIGUA' ELSE 'MODERNA' END",
    "hours": "CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1200 WHEN 2 THEN 600 ELSE 40 END",
    "kind": "CASE o_orderkey % 4 WHEN 0 THEN 'Taller' WHEN 1 THEN 'CERTIFICACIÓN' WHEN 2 THEN 'otra cosa' ELSE '' END",
    "start": "CASE WHEN o_orderkey % 17 = 0 THEN 'pronto' ELSE '10 de marzo de 2025' END",
    "end": "CASE WHEN o_orderkey % 19 = 0 THEN '2025-01-05' WHEN o_orderkey % 19 = 1 THEN 'junio 2042' ELSE 'junio 2025' END",
}


def _plans(spark, d):
    e = {k: F.expr(v) for k, v in _PLAN.items()}
    training = F.struct(F.lit("Curso de redes").alias("name"), e["hours"].cast("double").alias("hours"), e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"))
    return spread(table(spark, d, "orders")).select(
        F.col("o_orderkey").alias("id"), *(e[k].alias(k) for k in ("name", "career", "code", "period", "template")), F.lit("Magister").alias("level"),
        F.struct(*(F.lit("Sí, una respuesta").alias(k) for k in V.DIAGNOSIS)).alias("diagnosis"),
        F.when(F.col("o_orderkey") % 23 == 0, F.array().cast("array<struct<name:string,hours:double,start:string,end:string,kind:string>>")).otherwise(F.array(training)).alias("trainings"),
        F.when(F.col("o_orderkey") % 29 == 0, 2).otherwise(1).alias("expected_rows"), F.array(F.lit("leer")).alias("theory"), F.when(F.col("o_orderkey") % 31 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("hacer"))).alias("practice"),
        F.lit("mejora").alias("impact"), F.lit("a largo plazo").alias("vision"), F.lit(1).alias("engines"), F.when(F.col("o_orderkey") % 37 == 0, "ERROR").otherwise("").alias("status"),
    )


def _validated(spark, d):
    return V.validated_plans(_plans(spark, d), AS_OF_YEAR)


def _sql_issues() -> str:
    p = {k: f"({v})" for k, v in _PLAN.items()}
    n, c, code, per, old, h, kind, s, e = p["name"], p["career"], p["code"], p["period"], "o_orderkey % 3 = 0", p["hours"], p["kind"], p["start"], p["end"]
    rows = "o_orderkey % 23 <> 0"
    rules = [
        ("docente.nombre", f"{n} = ''", "error", "missing", "lectura", "estructura"),
        ("docente.nombre", f"length({n}) > 140", "error", "invalid", "lectura", "semantica"),
        ("docente.carrera", f"{c} = 'Total de horas 40'", "error", "invalid", "lectura", "semantica"),
        ("docente.codigo_documento", f"{code} = '' AND {old}", "warning", "warning", "plantilla", "plantilla"),
        ("docente.codigo_documento", f"{code} = '' AND NOT {old}", "error", "missing", "lectura", "lectura"),
        ("docente.codigo_documento", f"contains({code}, '-00-PRO')", "error", "invalid", "contenido", "campos"),
        ("docente.codigo_documento", f"{code} = 'X-1'", "error", "invalid", "lectura", "campos"),
        ("docente.periodo_plan", f"{per} = '' AND {old}", "warning", "warning", "plantilla", "plantilla"),
        ("docente.periodo_plan", f"{per} = '' AND NOT {old}", "error", "missing", "lectura", "cruzada"),
        ("docente.periodo_plan", f"contains({per}, '/')", "error", "invalid", "contenido", "campos"),
        ("docente.periodo_plan", f"{per} = '2024-01' AND ends_with({code}, '2025-12')", "error", "invalid", "contenido", "cruzada"),
        ("capacitaciones", f"NOT {rows}", "error", "missing", "lectura", "estructura"),
        ("capacitaciones.0.horas", f"{rows} AND {h} = 0", "error", "missing", "lectura", "campos"),
        ("capacitaciones.0.horas", f"{rows} AND {h} > 1000", "error", "invalid", "contenido", "semantica"),
        ("capacitaciones.0.horas", f"{rows} AND {h} = 600", "warning", "warning", "contenido", "semantica"),
        ("capacitaciones.0.fecha_inicio_propuesta", f"{rows} AND {s} = 'pronto'", "warning", "warning", "lectura", "campos"),
        ("capacitaciones.0.fecha_fin_propuesta", f"{rows} AND {e} = 'junio 2042'", "error", "invalid", "contenido", "semantica"),
        ("capacitaciones.0.fecha_fin_propuesta", f"{rows} AND {e} = '2025-01-05' AND {s} <> 'pronto'", "error", "invalid", "contenido", "cruzada"),
        ("capacitaciones.0.tipo", f"{rows} AND {kind} = ''", "error", "missing", "lectura", "campos"),
        ("capacitaciones.0.tipo", f"{rows} AND {kind} = 'otra cosa'", "error", "invalid", "lectura", "semantica"),
        ("capacitaciones", f"{rows} AND o_orderkey % 29 = 0", "error", "invalid", "lectura", "consenso"),
        ("detalles_plan.actividades_practicas", "o_orderkey % 31 = 0", "error", "missing", "lectura", "estructura"),
        ("_plantilla", old, "warning", "warning", "plantilla", "plantilla"),
    ]
    return " UNION ALL ".join(f"SELECT o_orderkey AS id, '{a}' AS path, '{sev}' AS severity, '{k}' AS kind, '{cat}' AS category, '{lay}' AS layer FROM orders WHERE ({when}) AND o_orderkey % 37 <> 0" for a, when, sev, k, cat, lay in rules)


def issue_map(spark, d):
    return X.issues_view(_validated(spark, d)).drop("name")


ISSUE_MAP = _sql_issues()


def layer_summary(spark, d):
    return V.layer_summary(_validated(spark, d), "id")


LAYER_SUMMARY = f"""WITH i AS ({_sql_issues()}), n AS (SELECT id, layer, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM i GROUP BY ALL)
SELECT o_orderkey AS id, l.layer AS layer, coalesce(e, 0)::INTEGER AS errors, coalesce(w, 0)::INTEGER AS warnings, coalesce(e, 0) = 0 AS ok
FROM orders CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in V.LAYERS)}]) AS layer) l LEFT JOIN n ON n.id = o_orderkey AND n.layer = l.layer"""


def confidence_status(spark, d):
    return _validated(spark, d).select("id", "confidence", "status", "detail")


CONFIDENCE_STATUS = f"""WITH i AS ({_sql_issues()}), n AS (SELECT id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'error' AND category = 'contenido') AS c FROM i GROUP BY id),
j AS (SELECT o_orderkey AS id, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(c, 0) AS c, CASE WHEN o_orderkey % 23 = 0 THEN 17 ELSE 21 END AS total FROM orders LEFT JOIN n ON n.id = o_orderkey)
SELECT id, greatest(0, least(100, floor((total - e - w * 0.15::DOUBLE) / total * 100 + 0.5)))::INTEGER AS confidence, CASE WHEN id % 37 = 0 THEN 'ERROR' WHEN e > 0 THEN 'REVISAR' ELSE 'COMPLETO' END AS status,
 CASE WHEN id % 37 = 0 THEN 'ERROR' WHEN c > 0 THEN 'REVISAR_CONTENIDO' WHEN e > 0 THEN 'REVISAR_LECTURA' WHEN id % 3 = 0 THEN 'PLANTILLA_ANTIGUA' WHEN w > 0 THEN 'COMPLETO_CON_ADVERTENCIAS' ELSE 'COMPLETO' END AS detail FROM j"""


def cross_field_check(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("a0"), F.expr("date_format(l_shipdate + make_dt_interval(cast(l_partkey % 5 as int) - 2), 'yyyy-MM-dd')").alias("b0"))
    # years of the forms begin with 20
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("20"), F.substring("a0", 3, 8)).alias("a"), F.concat(F.lit("20"), F.substring("b0", 3, 8)).alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", V.date_order_rule("end", loose_date("a"), loose_date("b")).when.alias("reversed"))


CROSS_FIELD_CHECK = """SELECT l_orderkey, l_linenumber, l_partkey, '20' || substr(strftime(l_shipdate + to_days((l_partkey % 5 - 2)::INTEGER), '%Y-%m-%d'), 3) < '20' || substr(strftime(l_shipdate, '%Y-%m-%d'), 3) AS reversed FROM lineitem"""


def needs_fallback_split(spark, d):
    """Plans that need another engine: no code on a modern form, fewer rows than expected, or two problems."""
    return with_fallback(_validated(spark, d)).groupBy("fallback").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


NEEDS_FALLBACK_SPLIT = f"""WITH i AS ({_sql_issues()}), n AS (SELECT id, count(*) FILTER (severity = 'error') AS e FROM i GROUP BY id)
SELECT (o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0) OR (CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 1 END) > (CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 END) OR coalesce(e, 0) >= 2 AS fallback, count(*) AS n, sum(o_orderkey)::BIGINT AS ids
FROM orders LEFT JOIN n ON id = o_orderkey GROUP BY 1"""


def export_teachers(spark, d):
    return X.teachers_view(_validated(spark, d)).select("id", "name", "career", "level", "code", "period", "status", "detail", "confidence", "n_trainings")


EXPORT_TEACHERS = f"""SELECT o_orderkey AS id, {_PLAN['name']} AS name, {_PLAN['career']} AS career, 'Magister' AS level, {_PLAN['code']} AS code, {_PLAN['period']} AS period, s.status, s.detail, s.confidence, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 END::INTEGER AS n_trainings
FROM orders JOIN ({CONFIDENCE_STATUS}) s ON s.id = o_orderkey"""


def export_trainings(spark, d):
    return X.trainings_view(_plans(spark, d))


EXPORT_TRAININGS = f"""SELECT o_orderkey AS id, {_PLAN['name']} AS name, {_PLAN['career']} AS career, 1 AS ordinal, 'Curso de redes' AS training, ({_PLAN['hours']})::DOUBLE AS hours, {_PLAN['start']} AS "start", {_PLAN['end']} AS "end", {_PLAN['kind']} AS kind FROM orders WHERE o_orderkey % 23 <> 0"""


def export_diagnoses(spark, d):
    return X.diagnoses_view(_plans(spark, d))


EXPORT_DIAGNOSES = f"SELECT o_orderkey AS id, {_PLAN['name']} AS name, {', '.join(f'''{chr(39)}Sí, una respuesta{chr(39)} AS {k}''' for k in V.DIAGNOSIS)} FROM orders"


def export_engines(spark, d):
    return X.engines_view(vote(_engine_rows(spark, d), ["c_custkey"]).withColumnRenamed("c_custkey", "doc_id").withColumn("field", F.lit("docente.nombre")))


EXPORT_ENGINES = f"SELECT c_custkey AS doc_id, 'docente.nombre' AS field, value, confidence, votes, engines FROM ({CONSENSUS_SCALAR_VOTE})"

_FLAGS = ("permiso", "total", "parcial")


def _agreement_rows(spark, d):
    c = F.col("c_custkey")
    support = F.array_compact(F.array(*(F.when(c % (k + 2) == 0, f) for k, f in enumerate(_FLAGS))))
    return table(spark, d, "customer").select(
        c.alias("id"), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("CGC-RGI2-"), (c % 90 + 1).cast("string"), F.lit("-PRO-134-2024-11"))).alias("code"), F.lit("2024-11-02").alias("signed_on"), F.lit("2024-11").alias("period"), F.lit("FIRMADO").alias("state"),
        F.lit("0102030405").alias("id_number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("career"), F.lit("Docente").alias("position"), F.lit("Redes").alias("training"), F.lit("p1").alias("plan_id"), (c % 3 != 0).alias("linked"), support.alias("support"),
        F.when(c % 7 == 0, F.lit(150.0)).otherwise(F.lit(50.0)).alias("percent"),
    )


def export_agreements(spark, d):
    return X.agreements_view(V.evaluated_agreements(_agreement_rows(spark, d))).select("id", "code", "linked", "permiso", "total", "parcial", "otro", "percent", "status", "confidence")


EXPORT_AGREEMENTS = """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'CGC-RGI2-' || (c_custkey % 90 + 1) || '-PRO-134-2024-11' END AS code, c_custkey % 3 <> 0 AS linked, c_custkey % 2 = 0 AS s1, c_custkey % 3 = 0 AS s2, c_custkey % 4 = 0 AS s3, CASE WHEN c_custkey % 7 = 0 THEN 150.0::DOUBLE ELSE 50.0::DOUBLE END AS percent FROM customer),
e AS (SELECT *, CASE WHEN code = '' THEN 1 ELSE 0 END + CASE WHEN linked THEN 0 ELSE 1 END + CASE WHEN NOT s1 AND NOT s2 AND NOT s3 THEN 1 WHEN s2 AND s3 THEN 1 ELSE 0 END + CASE WHEN s3 AND percent > 100 THEN 1 ELSE 0 END AS n FROM a)
SELECT id, code, CASE WHEN linked THEN 'Sí' ELSE 'No' END AS linked, CASE WHEN s1 THEN 'Sí' ELSE 'No' END AS permiso, CASE WHEN s2 THEN 'Sí' ELSE 'No' END AS total, CASE WHEN s3 THEN 'Sí' ELSE 'No' END AS parcial, 'No' AS otro, percent,
 CASE WHEN n > 0 THEN 'REVISAR' ELSE 'COMPLETO' END AS status, greatest(0, least(100, floor((11 - n)::DOUBLE / 11 * 100 + 0.5)))::INTEGER AS confidence FROM e"""


def support_labels(spark, d):
    return _agreement_rows(spark, d).select("id", F.array_join(X.support_labels(F.col("support"), F.col("percent").cast("int")), ", ").alias("labels"))


SUPPORT_LABELS = """SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'permiso' END, CASE WHEN c_custkey % 3 = 0 THEN 'total' END, CASE WHEN c_custkey % 4 = 0 THEN 'parcial ' || CASE WHEN c_custkey % 7 = 0 THEN 150 ELSE 50 END || '%' END], lambda x: x IS NOT NULL), ', ') AS labels FROM customer"""


def shared_details(spark, d):
    """Details of an order's rows pulled together and pushed into the rows that lack them."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Detalle "), (F.col("l_partkey") % 10).cast("string"))).otherwise("").alias("value"))
    return details_of(li, "l_orderkey", F.col("l_linenumber") * 1000000 + F.col("l_partkey")).drop("value")


SHARED_DETAILS = """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Detalle ' || (l_partkey % 10) ELSE '' END AS value FROM lineitem),
f AS (SELECT l_orderkey, value, min(l_linenumber * 1000000 + l_partkey) AS ord FROM li WHERE value <> '' GROUP BY ALL),
w AS (SELECT l_orderkey, string_agg(value, ' | ' ORDER BY ord) AS details FROM f GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN value <> '' THEN value ELSE coalesce(details, '') END AS details FROM li LEFT JOIN w USING (l_orderkey)"""


# --- upserts and duplicates ---


def _store_and_batch(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    base = c.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), k.alias("seq"), F.concat(F.lit("h"), k.cast("string")).alias("hash"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("code"), (k % 6 == 0).alias("manual"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    batch = c.where("c_custkey % 2 = 0").select(
        F.concat(F.lit("b"), k.cast("string")).alias("id"), k.alias("seq"), F.when(k % 10 == 0, F.concat(F.lit("new"), k.cast("string"))).when(k % 10 == 2, F.concat(F.lit("h"), k.cast("string"))).otherwise("").alias("hash"),
        F.when(k % 10 == 4, F.concat(F.lit("c"), k.cast("string"))).otherwise("").alias("code"), F.lit(False).alias("manual"), F.upper("c_name").alias("name"), F.lit("batch").alias("note"),
    )
    return base, batch


def upsert_two_key(spark, d):
    base, batch = _store_and_batch(spark, d)
    return R.two_key_upsert(base, batch, ["name"]).select("id", "hash", "code", "manual", "name", "note")


_STORE = """b AS (SELECT 's' || c_custkey AS id, c_custkey AS k, 'h' || c_custkey AS hash, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'c' || c_custkey END AS code, c_custkey % 6 = 0 AS manual, c_name AS name, c_mktsegment AS note FROM customer),
n AS (SELECT 'b' || c_custkey AS id, c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN 'new' || c_custkey WHEN 2 THEN 'h' || c_custkey ELSE '' END AS hash, CASE WHEN c_custkey % 10 = 4 THEN 'c' || c_custkey ELSE '' END AS code, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT n.*, n.k % 10 = 2 OR (n.k % 10 = 4 AND n.k % 4 <> 0) AS hit FROM n)"""
UPSERT_TWO_KEY = f"""WITH {_STORE}
SELECT CASE WHEN hit AND NOT manual THEN m.id ELSE b.id END AS id, CASE WHEN hit THEN m.hash ELSE b.hash END AS hash, CASE WHEN hit THEN m.code ELSE b.code END AS code, manual, CASE WHEN hit AND NOT manual THEN m.name ELSE b.name END AS name, CASE WHEN hit THEN 'batch' ELSE b.note END AS note
FROM b LEFT JOIN m ON m.k = b.k AND hit
UNION ALL SELECT id, hash, code, false, name, 'batch' FROM m WHERE NOT hit"""


def manual_lock(spark, d):
    base, batch = _store_and_batch(spark, d)
    edits = base.where("seq % 9 = 0").select("id", F.lower("name").alias("name"))
    return R.update_by_id(base, edits, ["name"]).select("id", "name", "manual")


MANUAL_LOCK = "SELECT 's' || c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN lower(c_name) ELSE c_name END AS name, c_custkey % 9 = 0 OR c_custkey % 6 = 0 AS manual FROM customer"


def ai_merge_policy(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(c % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("career"), F.when(c % 5 == 0, "").otherwise("sugerido").alias("s_name"), F.lit("otra").alias("s_career"), F.when(c % 4 == 0, F.array(F.lit("career"))).otherwise(F.array().cast("array<string>")).alias("flagged"))
    return R.merged_suggestions(rows, ["name", "career"]).drop("flagged")


AI_MERGE_POLICY = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'sugerido' END ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'otra' ELSE c_mktsegment END AS career,
 array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'name' END, CASE WHEN c_custkey % 4 = 0 THEN 'career' END], lambda x: x IS NOT NULL), ',') AS taken FROM customer"""


def dedup_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("kept_id"))
    return docs.join(first, "hash").select("doc_id", "kept_id")


DEDUP_EXACT = "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id FROM documents"


def dedup_fold(spark, d):
    """Three noisy copies of each supplier, all folded in order."""
    s = table(spark, d, "supplier").select("s_suppkey", F.posexplode(F.array(F.lit(""), F.lit("a"), F.lit("."))).alias("copy", "noise"))
    name = F.concat(F.lit("Docente "), F.md5(F.col("s_suppkey").cast("string")), F.col("noise"))
    code = F.when(F.col("copy") == 2, F.concat(F.lit("UGPA-RGI1-"), F.lpad((F.col("s_suppkey") % 999 + 1).cast("string"), 3, "0"), F.lit("-PRO-251-2025-12"))).otherwise("")
    rows = s.select((F.col("s_suppkey") * 3 + F.col("copy")).alias("id"), (F.col("s_suppkey") * 3 + F.col("copy")).alias("seq"), F.lit("").alias("hash"), code.alias("code"), F.lit("2025-12").alias("period"), name.alias("name"), F.lit("Derecho").alias("career"), F.array(F.lit("Curso de redes")).alias("trainings"), F.lit(False).alias("alias"))
    return R.consolidated_all(rows)


QUERIES = {
    "scan_project": (scan_project, SCAN_PROJECT),
    "file_hash_dedup": (file_hash_dedup, FILE_HASH_DEDUP),
    "search_filter": (search_filter, SEARCH_FILTER),
    "status_label": (status_label, STATUS_LABEL),
    "kpi_summary": (kpi_summary, KPI_SUMMARY),
    "kpi_review_tile": (kpi_review_tile, KPI_REVIEW_TILE),
    "consensus_scalar_vote": (consensus_scalar_vote, CONSENSUS_SCALAR_VOTE),
    "cell_vote": (cell_vote_query, CELL_VOTE),
    "best_text": (best_text_query, BEST_TEXT),
    "list_union_distinct": (list_union_distinct, LIST_UNION_DISTINCT),
    "row_alignment": (row_alignment, None),
    "link_argmax": (link_argmax, LINK_ARGMAX),
    "options_flatten": (options_flatten, OPTIONS_FLATTEN),
    "canonical_dim_match": (canonical_dim_match, CANONICAL_DIM_MATCH),
    "issue_map": (issue_map, ISSUE_MAP),
    "layer_summary": (layer_summary, LAYER_SUMMARY),
    "confidence_status": (confidence_status, CONFIDENCE_STATUS),
    "cross_field_check": (cross_field_check, CROSS_FIELD_CHECK),
    "needs_fallback_split": (needs_fallback_split, NEEDS_FALLBACK_SPLIT),
    "export_teachers": (export_teachers, EXPORT_TEACHERS),
    "export_trainings": (export_trainings, EXPORT_TRAININGS),
    "export_diagnoses": (export_diagnoses, EXPORT_DIAGNOSES),
    "export_engines": (export_engines, EXPORT_ENGINES),
    "export_agreements": (export_agreements, EXPORT_AGREEMENTS),
    "support_labels": (support_labels, SUPPORT_LABELS),
    "shared_details": (shared_details, SHARED_DETAILS),
    "upsert_two_key": (upsert_two_key, UPSERT_TWO_KEY),
    "manual_lock": (manual_lock, MANUAL_LOCK),
    "ai_merge_policy": (ai_merge_policy, AI_MERGE_POLICY),
    "dedup_exact": (dedup_exact, DEDUP_EXACT),
    "dedup_fold": (dedup_fold, None),
}
