"""Queries of a store kept over time: batches, second readings, audit, migration, corrections by path, search index, figures, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as H
from ..operators import corrections as K
from ..operators import extraction as E
from ..operators import incremental as I
from ..operators import migration as G
from ..operators import processing as P
from ..operators import search_index as S
from ..operators import suggestions as R
from ..operators import views as V
from ..operators.validation import DIAGNOSIS
from ..shared import spread
from ..streaming import readings as D
from .common import table
from .process_queries import _FORM, _MERGED, _flat, _supplier_plans

# --- a store that takes in batches: the second and the third reading of every supplier's plan come later ---


def incremental_consolidation(spark, d):
    plans = _supplier_plans(spark, d)
    state = I.started(plans.where("id % 3 = 0"))
    for copy in (1, 2):
        state, _ = I.upserted(state, plans.where(f"id % 3 = {copy}"))
    return state.merged.select(*_flat(state.merged))


def audit_log(spark, d):
    """What cleaning, code repair and merging change in three readings of every supplier's plan."""
    _, log = H.audited_plans(_supplier_plans(spark, d))
    return log.select("id", "step", "path", F.when(F.col("path").isin("trainings", "theory", "practice"), "").otherwise(F.col("after")).alias("after"), "reason")


#: Repair spells a sequence with two digits, the given codes have three.
_CODE_OF = "'UGPA-RGI1-' || lpad((s_suppkey % 999 + 1)::VARCHAR, CASE WHEN s_suppkey % 999 + 1 < 100 THEN 2 ELSE 3 END, '0') || '-PRO-251-' || (2000 + s_suppkey // 11988 % 100) || '-' || lpad((s_suppkey // 999 % 12 + 1)::VARCHAR, 2, '0')"
_PERIOD_OF = "(2000 + s_suppkey // 11988 % 100) || '-' || lpad((s_suppkey // 999 % 12 + 1)::VARCHAR, 2, '0')"
_FROM_OTHERS = " UNION ALL ".join(
    f"SELECT s_suppkey * 3, 3, '{path}', {after}, 'taken from a duplicate' FROM supplier WHERE {when}"
    for path, after, when in (
        ("name", "'Docente ' || md5(s_suppkey::VARCHAR) || '.'", "s_suppkey % 7 <> 0"), ("level", "'Nivel ' || s_suppkey % 9", "true"), ("code", _CODE_OF, "true"), ("period", _PERIOD_OF, "true"),
        ("vision", "'a largo plazo'", "true"), ("trainings", "''", "true"), ("theory", "''", "s_suppkey % 7 <> 0"), ("practice", "''", "true"),
    )
)
# the third reading has a code, whose period is filled in; the first one stays and takes what the others have
AUDIT_LOG = f"""SELECT s_suppkey * 3 + 2 AS id, 1 AS step, 'period' AS path, {_PERIOD_OF} AS after, 'period of the code' AS reason FROM supplier
UNION ALL SELECT s_suppkey * 3 + 2, 2, 'code', {_CODE_OF}, 'code repaired by vote' FROM supplier WHERE s_suppkey % 999 + 1 < 100
UNION ALL {_FROM_OTHERS}
UNION ALL SELECT s_suppkey * 3 + copy, 3, '_record', (s_suppkey * 3)::VARCHAR, 'duplicate' FROM supplier, (SELECT unnest([1, 2]) AS copy)"""


def store_migration(spark, d):
    """A store of an earlier version: every plan three times, some of them taken for something else."""
    plans = _supplier_plans(spark, d)
    k = F.col("id")
    store = plans.withColumns({"remarks": F.array(F.lit("No corresponde a un plan individual."), F.lit("otra")), "status": F.when(k % 6 == 0, "NO_ES_PLAN").otherwise("REVISAR")})
    _, log = G.migrated_plans(store, 2026)
    return log.select("id", "kept_id", "action", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"), F.col("new.rescued").alias("rescued"), F.col("new.code").alias("code"), F.size("new.remarks").alias("n_remarks"))


# a valid code of a record corrected by hand keeps its spelling
STORE_MIGRATION = f"""SELECT s_suppkey * 3 + copy AS id, s_suppkey * 3 AS kept_id, CASE copy WHEN 0 THEN 'changed' ELSE 'merged' END AS action, CASE WHEN (s_suppkey * 3 + copy) % 6 = 0 THEN 'NO_ES_PLAN' ELSE 'REVISAR' END AS old_status,
 'REVISAR' AS new_status, s_suppkey % 2 = 0 AS rescued, CASE WHEN s_suppkey % 7 = 0 THEN replace({_CODE_OF}, 'RGI1-' || lpad((s_suppkey % 999 + 1)::VARCHAR, 2, '0') || '-', 'RGI1-' || lpad((s_suppkey % 999 + 1)::VARCHAR, 3, '0') || '-') ELSE {_CODE_OF} END AS code, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS n_remarks FROM supplier, (SELECT unnest([0, 1, 2]) AS copy)"""

# --- second readings ---

#: A form that is filled in whole, as _FORM is not.
_WHOLE = _FORM.replace(
    "¿Cuál es tu nivel académico actual",
    "¿En qué curso o programa de actualización has participado en los últimos 12 meses?\\nRedes de datos\\n¿Podrías mencionar uno o más avances recientes en tu campo disciplinar que hayas aplicado en tus clases?\\nAula inversa\\n"
    "¿Qué tan cómodo/a te sientes implementando nuevas metodologías de enseñanza en el aula?\\nMuy cómodo\\n¿Qué estrategias pedagógicas innovadoras aplicas en tu práctica docente?\\nProyectos y casos\\n"
    "¿Qué formación académica adicional consideras necesaria para fortalecer tu perfil profesional?\\nUna maestría\\n¿La formación académica que propones es específica o genérica?\\nEspecífica del área\\n¿Cuál es tu nivel académico actual",
)


def second_reading(spark, d):
    """Plans read by one engine: whole ones, ones whose code can't be read, ones without text. A second engine then reads what is in doubt."""
    known = "concat('UGPA-RGI1-', lpad(cast(c_custkey % 150 + 1 as string), 2, '0'), '-PRO-251-2025-12')"
    values = {"name": "c_name", "career": "'Enfermería'", "code": known, "aula": "c_mktsegment", "hours": "cast(c_custkey % 40 + 1 as string)", "more": "'30'"}
    k = F.col("c_custkey")
    customers = spread(table(spark, d, "customer"))
    good, coded = F.expr(_WHOLE.format(**values)), F.expr(_WHOLE.format(**{**values, "code": "'ilegible'"}))
    first = customers.select(k.alias("doc_id"), F.lit("DIGITAL_LINEAL").alias("engine"), F.lit(0).alias("seq"), F.when(k % 3 == 0, good).when(k % 3 == 1, coded).otherwise("sin texto").alias("text"))
    again = customers.select(k.alias("doc_id"), F.lit("OCR_TEXTO").alias("engine"), F.lit(1).alias("seq"), F.expr(_WHOLE.format(**{**values, "name": "concat('Ocr ', c_name)", "aula": "'otra'"})).alias("text"))
    first, again = (x.withColumns({"file_name": F.lit("plan.pdf"), "region_text": F.lit("")}) for x in (first, again))
    out = P.twice_processed_plans(first, again, 2026)
    return out.select("doc_id", "name", "code", F.col("diagnosis.herramientas_tecnologicas").alias("tools"), F.size("trainings").alias("n_trainings"), "engines", "reread", "status")


SECOND_READING = """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 2 THEN 'Ocr ' || c_name ELSE c_name END AS name, 'UGPA-RGI1-' || lpad((c_custkey % 150 + 1)::VARCHAR, 2, '0') || '-PRO-251-2025-12' AS code,
 'Aula ' || CASE WHEN c_custkey % 3 = 2 THEN 'otra' ELSE c_mktsegment END AS tools, 2::INTEGER AS n_trainings, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END::INTEGER AS engines, c_custkey % 3 <> 0 AS reread, 'COMPLETO' AS status FROM customer"""

# --- corrections by path ---


def path_corrections(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    row = lambda name, hours: F.struct(F.lit(name).alias("name"), hours.cast("double").alias("hours"), F.lit("enero de 2025").alias("start"), F.lit("mayo de 2025").alias("end"), F.lit("Taller").alias("kind"))
    store = c.select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("career"), F.lit("").alias("level"), F.lit("").alias("code"), F.lit("").alias("period"), F.lit(False).alias("manual"), F.struct(*(F.lit("r").alias(q) for q in DIAGNOSIS)).alias("diagnosis"),
                     F.array(row("Redes", k % 9 + 1), row("Salud", F.lit(8))).alias("trainings"), F.array(F.lit("leer")).alias("theory"), F.array(F.lit("hacer")).alias("practice"), F.lit("i").alias("impact"), F.lit("v").alias("vision"))
    edit = lambda seq, path, value: F.struct(F.lit(seq).alias("seq"), F.lit(path).alias("path"), value.cast("string").alias("value"))
    edits = F.array(
        edit(1, "capacitaciones.0.horas", F.lit("3")), edit(2, "capacitaciones.0.horas", k % 50 + 10), edit(3, "capacitaciones.1", F.lit("")), edit(4, "capacitaciones.2.nombre", F.concat(F.lit(" Nueva "), k.cast("string"))), edit(5, "docente.codigo_documento", F.lit("UGPA-RGI1-44-PRO-251-2025-12")),
        edit(6, "diagnostico.tipo_formacion", F.col("c_mktsegment")), edit(7, "detalles_plan.actividades_practicas", F.concat(F.lit("uno | "), k.cast("string"))), edit(8, "docente.edad", F.lit("x")),
    )
    out = K.corrected_by_path(store, c.where("c_custkey % 4 = 0").select(k.alias("id"), F.inline(edits)), 2026)
    shown = F.transform("trainings", lambda t: F.concat_ws("/", t["name"], t["hours"].cast("int").cast("string"), t["start"]))
    return out.select("id", F.array_join(shown, ";").alias("trainings"), "code", "period", F.col("diagnosis.tipo_formacion").alias("kind"), F.array_join("practice", ";").alias("practice"), "manual", "n_edits", F.array_join("rejected", ";").alias("rejected"), F.size("issues").alias("n_issues"))


# issues: level, and without a code also code and period; a new row has no hours, dates and kind
PATH_CORRECTIONS = """SELECT c_custkey AS id, CASE WHEN e THEN 'Redes/' || (c_custkey % 50 + 10) || '/enero de 2025;Nueva ' || c_custkey || '/0/' ELSE 'Redes/' || (c_custkey % 9 + 1) || '/enero de 2025;Salud/8/enero de 2025' END AS trainings, CASE WHEN e THEN 'UGPA-RGI1-44-PRO-251-2025-12' ELSE '' END AS code,
 CASE WHEN e THEN '2025-12' ELSE '' END AS period, CASE WHEN e THEN c_mktsegment ELSE 'r' END AS kind, CASE WHEN e THEN 'uno;' || c_custkey ELSE 'hacer' END AS practice, e AS manual, CASE WHEN e THEN 6 ELSE 0 END::INTEGER AS n_edits, CASE WHEN e THEN 'docente.edad' ELSE '' END AS rejected,
 CASE WHEN e THEN 5 ELSE 3 END::INTEGER AS n_issues FROM (SELECT *, c_custkey % 4 = 0 AS e FROM customer)"""

def row_suggestions(spark, d):
    """Suggested values for plans some of whose cells are empty or wrong."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    row = lambda name, hours, start: F.struct(name.alias("name"), hours.cast("double").alias("hours"), start.alias("start"), F.lit("").alias("end"), F.lit("Taller").alias("kind"))
    issue = lambda path, when: F.when(when, F.struct(F.lit(path).alias("path"), F.lit("error").alias("severity")))
    records = c.select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("career"), F.struct(*(F.lit("r").alias(q) for q in DIAGNOSIS)).alias("diagnosis"),
                       F.slice(F.array(row(F.lit("Redes"), k % 3, F.lit("")), row(F.lit("Salud"), F.lit(8), F.lit("mayo"))), F.lit(1), (k % 3).cast("int")).alias("trainings"), F.array(F.lit("leer")).alias("theory"), F.array().cast("array<string>").alias("practice"), F.lit("v").alias("vision"),
                       F.array_compact(F.array(issue("docente.nombre", k % 5 == 0), issue("capacitaciones.1.horas", k % 7 == 0), issue("capacitaciones.0.actividades_teoricas", k % 4 == 0))).alias("issues"))
    offered = F.array(row(F.lit("Nueva"), F.lit(40), F.lit("enero")), row(F.lit("Otra"), k % 50 + 10, F.lit("junio")))
    suggestions = c.where("c_custkey % 6 <> 1").select(k.alias("id"), F.concat(F.lit("Docente "), k.cast("string")).alias("name"), F.lit("Derecho").alias("career"), offered.alias("trainings"), F.array(F.lit("ver")).alias("theory"), F.array(F.lit("armar")).alias("practice"))
    out = R.with_suggestions(records, suggestions)
    shown = F.transform("trainings", lambda t: F.concat_ws("/", t["name"], t["hours"].cast("int").cast("string"), t["start"]))
    return out.select("id", "name", "career", F.array_join(shown, ";").alias("trainings"), F.array_join("theory", ";").alias("theory"), F.array_join("practice", ";").alias("practice"), F.size("taken").alias("n_taken"))


# rows: none, one whose start is empty, or two, of which the second may have a problem with its hours
ROW_SUGGESTIONS = """WITH c AS (SELECT *, c_custkey % 6 <> 1 AS s, c_custkey % 3 AS n FROM customer)
SELECT c_custkey AS id, CASE WHEN s AND c_custkey % 5 = 0 THEN 'Docente ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN s THEN 'Derecho' ELSE '' END AS career,
 CASE WHEN n = 0 AND s THEN 'Nueva/40/enero;Otra/' || (c_custkey % 50 + 10) || '/junio' WHEN n = 0 THEN '' ELSE 'Redes/' || n || '/' || CASE WHEN s THEN 'enero' ELSE '' END || CASE WHEN n = 2 THEN ';Salud/' || CASE WHEN s AND c_custkey % 7 = 0 THEN c_custkey % 50 + 10 ELSE 8 END || '/mayo' ELSE '' END END AS trainings,
 CASE WHEN s AND c_custkey % 4 = 0 THEN 'ver' ELSE 'leer' END AS theory, CASE WHEN s THEN 'armar' ELSE '' END AS practice,
 (CASE WHEN s THEN 2 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN n = 2 AND c_custkey % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END)::INTEGER AS n_taken FROM c"""

# --- search, labels, figures ---


def substring_index(spark, d):
    """Parts of names and segments looked up in all customers by the index."""
    c = spread(table(spark, d, "customer"))
    texts = S.search_texts(c, "c_custkey", ["c_name", "c_mktsegment"])
    lists, df = S.postings(texts, "c_custkey")
    parts = F.array(F.substring("c_name", -3, 3), F.substring("c_name", 6, 6), F.substring("c_mktsegment", 2, 5), F.substring("c_mktsegment", 1, 2), F.concat(F.substring("c_name", -1, 1), F.lit(" "), F.col("c_mktsegment")))
    found = S.search_all(texts, lists, df, c.select(F.explode(parts).alias("needle")), "c_custkey")
    return found.groupBy("needle").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.sum("c_custkey").alias("ids"))


SUBSTRING_INDEX = """WITH w AS (SELECT DISTINCT lower(trim(unnest([right(c_name, 3), substr(c_name, 6, 6), substr(c_mktsegment, 2, 5), substr(c_mktsegment, 1, 2), right(c_name, 1) || ' ' || c_mktsegment]))) AS needle FROM customer)
SELECT needle, count(*) AS n, min(c_custkey) AS first, sum(c_custkey)::BIGINT AS ids FROM w JOIN customer ON contains(lower(c_name || ' ' || c_mktsegment), needle) GROUP BY needle"""


def label_look_ahead(spark, d):
    """Labels whose value stands behind them, on the next line, on several, or too far down."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    text = F.concat_ws(
        "\n", F.when(k % 3 == 0, F.concat(F.lit("Número: "), key)).when(k % 3 == 1, F.concat(F.lit("NÚMERO\n\n"), key)).otherwise(F.concat(F.lit("Número\nEstado: x\n"), key)), F.concat(F.lit("Prioridad "), "o_orderpriority"),
        F.lit("Detalle:"), F.when(k % 2 == 0, F.concat(F.lit("uno\ndos\n1. tres "), key)).otherwise(F.concat(F.lit("a\nb\nc\nd\ne "), key)),
    )
    docs = table(spark, d, "orders").select(k.alias("doc_id"), text.alias("text"))
    return E.label_values(docs, "doc_id", {"number": "numero", "priority": "prioridad", "detail": "detalle"}, ("estado",), 4, ("detail",))


LABEL_LOOK_AHEAD = """SELECT o_orderkey AS doc_id, 'number' AS label, o_orderkey::VARCHAR AS value FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT o_orderkey, 'priority', CASE WHEN contains(o_orderpriority, '-') THEN trim(regexp_extract(o_orderpriority, '-(.*)$', 1)) ELSE o_orderpriority END FROM orders
UNION ALL SELECT o_orderkey, 'detail', CASE WHEN o_orderkey % 2 = 0 THEN 'uno dos' ELSE 'a b c d' END FROM orders"""


def figures_by_level(spark, d):
    """Orders by status and priority, by status, and in all: how many, of how many customers, and what for."""
    figures = {"n": F.count("*"), "customers": F.count_distinct("o_custkey"), "large": F.count(F.when(F.col("o_totalprice") > 200000, 1))}
    return V.multi_level_figures(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], figures)


FIGURES_BY_LEVEL = """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS grouping_id, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS large
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""



def stream_readings(spark, d):
    """Events as a stream of readings: what each user's kinds of events said last, and how many distinct ones there were."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    readings = events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("engine"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("props").alias("value"))
    return D.kept(D.documents(readings), "stream-readings")


STREAM_READINGS = """WITH r AS (SELECT user_id AS doc_id, event_type AS engine, epoch_us(ts) AS at_, coalesce(props, '') AS value FROM events),
n AS (SELECT doc_id, count(*) AS n_readings FROM (SELECT DISTINCT * FROM r) GROUP BY doc_id),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, engine ORDER BY at_ DESC, value DESC) = 1)
SELECT doc_id, engine, at_ AS at, value, n_readings FROM l JOIN n USING (doc_id)"""

QUERIES = {
    "incremental_consolidation": (incremental_consolidation, _MERGED),
    "audit_log": (audit_log, AUDIT_LOG),
    "store_migration": (store_migration, STORE_MIGRATION),
    "second_reading": (second_reading, SECOND_READING),
    "path_corrections": (path_corrections, PATH_CORRECTIONS),
    "row_suggestions": (row_suggestions, ROW_SUGGESTIONS),
    "substring_index": (substring_index, SUBSTRING_INDEX),
    "label_look_ahead": (label_look_ahead, LABEL_LOOK_AHEAD),
    "stream_readings": (stream_readings, STREAM_READINGS),
    "figures_by_level": (figures_by_level, FIGURES_BY_LEVEL),
}
