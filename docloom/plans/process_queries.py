"""Queries of record merging, corrections by hand, end-to-end processing and page reading over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaners import is_useful_plan, teacher_name, training_name
from ..functions.codes import code_candidates
from ..operators import geometry as G
from ..operators import merging as M
from ..operators import processing as P
from ..operators.records import record_quality
from ..operators.validation import DIAGNOSIS
from ..shared import spread
from .common import ORDER_LINES, order_lines, sql_clean, table

# --- fields ---

_NOISY_NAME = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' UGPA-RGI1-' || c_custkey || chr(10) || 'x' WHEN 1 THEN c_name || '  PRO-251-44-2025-12' WHEN 2 THEN c_name || ' 251-2025-7 ' ELSE '  ' || c_name END"
_NOISY_TRAINING = "CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 30) || '. ' || c_mktsegment || ' basico 40 horas Desde enero' WHEN 1 THEN '* ' || c_mktsegment || ' Aprobación' WHEN 2 THEN c_mktsegment || ' Desde marzo' WHEN 3 THEN c_mktsegment || ' avanzado certificacion x' ELSE c_mktsegment || ';' END"


def field_cleaners(spark, d):
    return table(spark, d, "customer").select("c_custkey", teacher_name(F.expr(_NOISY_NAME.replace("chr(10)", "char(10)"))).alias("name"), training_name(F.expr(_NOISY_TRAINING)).alias("training"))


FIELD_CLEANERS = """SELECT c_custkey, trim(c_name) AS name, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ' basico' WHEN 3 THEN c_mktsegment || ' avanzado' ELSE c_mktsegment END AS training FROM customer"""

_CODE = "'UGPA-RGI' || (o_orderkey % 2 + 1) || '-' || {s} || '-PRO-251-20' || {y} || '-' || {m}"
_SEQ, _YEAR, _MONTH = "lpad(cast(o_orderkey % 150 + 1 as string), 2, '0')", "cast(o_orderkey % 30 + 10 as string)", "lpad(cast(o_orderkey % 12 + 1 as string), 2, '0')"
#: Codes as OCR reads them: letters for digits, digits for letters, lost dashes, other text between the parts.
_MISREAD = f"""CASE o_orderkey % 6
 WHEN 0 THEN 'ver ' || {_CODE.format(s=_SEQ, y=_YEAR, m=_MONTH)} || '.'
 WHEN 1 THEN 'U6PA R6I ' || (o_orderkey % 2 + 1) || ' ' || translate({_SEQ}, '015', 'OIS') || ' PR0 25I 20' || translate({_YEAR}, '0158', 'QLSB') || ' ' || {_MONTH} || ' fin'
 WHEN 2 THEN 'UGP4 / RG1 / ' || (o_orderkey % 2 + 1) || ' / ' || {_SEQ} || ' / PRO / 251 / 20' || {_YEAR} || ' / ' || {_MONTH}
 WHEN 3 THEN 'UGPA numero RGI' || (o_orderkey % 2 + 1) || ' y ' || {_SEQ} || ' y PRO y 251 y 20' || {_YEAR} || ' y ' || {_MONTH} || ' y'
 WHEN 4 THEN 'UG PA-RG I' || (o_orderkey % 2 + 1) || '-' || {_SEQ} || '-PR O-25 1-20' || {_YEAR} || '-' || {_MONTH} || ' x'
 ELSE 'sin codigo PRO 251' END"""


def code_misread(spark, d):
    """Codes out of badly read texts, with how sure they are."""
    found = spread(table(spark, d, "orders")).select("o_orderkey", F.explode_outer(code_candidates(F.expr(_MISREAD))).alias("c"))
    return found.select("o_orderkey", F.coalesce("c.code", F.lit("")).alias("code"), F.coalesce("c.confidence", F.lit(0)).alias("confidence"))


CODE_MISREAD = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE {_CODE.format(s=_SEQ, y=_YEAR, m=_MONTH)} END AS code, CASE o_orderkey % 6 WHEN 3 THEN 88 WHEN 2 THEN 94 WHEN 4 THEN 94 WHEN 5 THEN 0 ELSE 98 END::INTEGER AS confidence FROM orders""".replace(" as string)", " as varchar)")


def record_quality_query(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, "UGPA-RGI1-44-PRO-251-2025-12").otherwise("x")
    answers = F.array(F.col("c_name"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Total de horas "), F.col("c_name"))), F.repeat("c_mktsegment", 5))
    return c.select("c_custkey", record_quality(F.col("c_name"), F.col("c_mktsegment"), code, F.when(k % 5 == 0, "2025-12").otherwise(""), k % 7 == 0, answers, (k % 6).cast("int")).cast("int").alias("quality"))


_VALUE = "least(20, ceil(length({x}) / 8.0))"
_TEXT = "greatest(0, least(24, ceil(length({x}) / 10.0)))"
RECORD_QUALITY = f"""SELECT c_custkey, (CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 120 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE 0 END
 + {_VALUE.format(x=sql_clean('c_name'))} + {_VALUE.format(x=sql_clean('c_mktsegment'))} + {_TEXT.format(x=sql_clean('c_name'))} + {_TEXT.format(x=sql_clean('repeat(c_mktsegment, 5)'))} - c_custkey % 6 * 3)::INTEGER AS quality FROM customer"""


def useful_plans(spark, d):
    k = F.col("o_orderkey")
    answers = F.array(F.when(k % 2 == 0, "a").otherwise(" "), F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "c").otherwise(""))
    trainings = F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", is_useful_plan(F.when(k % 11 == 0, " ").otherwise("n"), F.when(k % 13 == 0, F.lit(None)).otherwise("c"), answers, trainings).alias("useful"))


USEFUL_PLANS = """SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND ((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) >= 2 OR o_orderkey % 7 = 0) AS useful FROM orders"""

# --- merging: three readings of each supplier's plan ---


def _supplier_plans(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.posexplode(F.array(F.lit(""), F.lit("a"), F.lit("."))).alias("copy", "noise"))
    k, copy = F.col("s_suppkey"), F.col("copy")
    code = F.expr("concat('UGPA-RGI1-', lpad(cast(s_suppkey % 999 + 1 as string), 3, '0'), '-PRO-251-', cast(2000 + (s_suppkey div 11988) % 100 as string), '-', lpad(cast((s_suppkey div 999) % 12 + 1 as string), 2, '0'))")
    row = lambda name, hours, start: F.array(F.struct(F.lit(name).alias("name"), hours.cast("double").alias("hours"), F.lit(start).alias("start"), F.lit("").alias("end"), F.lit("Taller").alias("kind")))
    trainings = F.when(copy == 0, row("1. Curso de redes", F.lit(0), "enero de 2025")).when(copy == 1, F.concat(row("Curso de redes", k % 40 + 1, "enero de 2025"), row("Salud y cuidado", F.lit(8), ""))).otherwise(row("Curso de redes", F.lit(0), ""))
    answer = F.when(copy == 2, "").otherwise(F.concat(F.lit("Respuesta "), k.cast("string")))
    return s.select(
        (k * 3 + copy).alias("id"), (k * 3 + copy).alias("seq"), F.lit("").alias("hash"), F.concat(F.lit("plan"), copy.cast("string"), F.lit("-"), k.cast("string"), F.lit(".pdf")).alias("file_name"), ((copy == 0) & (k % 7 == 0)).alias("manual"),
        F.concat(F.lit("Docente "), F.md5(k.cast("string")), F.col("noise")).alias("name"), F.when(copy == 1, "DERECHO").otherwise("Derecho").alias("career"), F.when(copy == 1, F.concat(F.lit("Nivel "), (k % 9).cast("string"))).otherwise("").alias("level"),
        F.when(copy == 2, code).otherwise("").alias("code"), F.lit("").alias("period"), F.struct(*(answer.alias(q) for q in DIAGNOSIS)).alias("diagnosis"), trainings.alias("trainings"),
        F.array(F.when(copy == 0, "Leer").otherwise("leer. ")).alias("theory"), F.array(F.concat(F.lit("Hacer "), copy.cast("string"))).alias("practice"), F.lit("mejora").alias("impact"), F.when(copy == 2, "a largo plazo").otherwise("").alias("vision"),
    )


def _flat(plans):
    shown = F.transform("trainings", lambda t: F.concat_ws("/", t["name"], t["hours"].cast("int").cast("string"), t["start"], t["kind"]))
    return [F.col("id"), F.col("name"), F.col("career"), F.col("level"), F.col("code"), F.col("period"), F.col("manual"), F.col("n_records"), F.col("diagnosis.tipo_formacion").alias("answer"), F.array_join(shown, ";").alias("trainings"), F.array_join("theory", ";").alias("theory"), F.array_join("practice", ";").alias("practice"), F.col("vision"), F.size("files").alias("n_files")]


def merge_records(spark, d):
    plans = M.merged_plans(_supplier_plans(spark, d))
    return plans.select(*_flat(plans))


# the third reading has the code and leads, the second lends rows and level; a record corrected by hand leads and keeps its values and hours
_MERGED = """SELECT s_suppkey * 3 AS id, 'Docente ' || md5(s_suppkey::VARCHAR) || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '.' END AS name, 'Derecho' AS career, 'Nivel ' || s_suppkey % 9 AS level,
 'UGPA-RGI1-' || lpad((s_suppkey % 999 + 1)::VARCHAR, 3, '0') || '-PRO-251-' || (2000 + s_suppkey // 11988 % 100) || '-' || lpad((s_suppkey // 999 % 12 + 1)::VARCHAR, 2, '0') AS code,
 (2000 + s_suppkey // 11988 % 100) || '-' || lpad((s_suppkey // 999 % 12 + 1)::VARCHAR, 2, '0') AS period, s_suppkey % 7 = 0 AS manual, 3 AS n_records, 'Respuesta ' || s_suppkey AS answer,
 'Curso de redes/' || CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 40 + 1 END || '/enero de 2025/Taller;Salud y cuidado/8//Taller' AS trainings,
 CASE WHEN s_suppkey % 7 = 0 THEN 'Leer' ELSE 'leer.' END AS theory, CASE WHEN s_suppkey % 7 = 0 THEN 'Hacer 0;Hacer 1;Hacer 2' ELSE 'Hacer 2;Hacer 1;Hacer 0' END AS practice, 'a largo plazo' AS vision, 3 AS n_files FROM supplier"""


def plan_upsert(spark, d):
    """A store with the first readings of most suppliers' plans, a batch with all others."""
    plans = _supplier_plans(spark, d)
    stored = (F.col("id") % 3 == 0) & (F.col("id") % 5 != 0)
    out = M.upserted_plans(plans.where(stored), plans.where(~stored))
    return out.select("action", *_flat(out))


PLAN_UPSERT = f"SELECT *, CASE WHEN id % 5 = 0 THEN 'inserted' ELSE 'updated' END AS action FROM ({_MERGED})"


# --- corrections by hand ---


def plan_corrections(spark, d):
    k = F.col("c_custkey")
    store = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("career"), F.lit("").alias("level"), F.lit("").alias("code"), F.lit("").alias("period"), (k % 6 == 0).alias("manual"), F.array(F.lit("Requiere confirmación manual."), F.lit("otra")).alias("remarks")).withColumnRenamed("c_custkey", "id")
    edits = table(spark, d, "customer").where("c_custkey % 4 = 0").select(k.alias("id"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name"), F.lit("Derecho").alias("career"), F.lit(None).cast("string").alias("level"), F.lit(" UGPA-RGI1-44-PRO-251-2025-12").alias("code"), F.when(k % 8 == 0, "2024-01").otherwise(" ").alias("period"))
    return M.corrected_plans(store, edits).withColumn("remarks", F.array_join("remarks", ";"))


PLAN_CORRECTIONS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'Derecho' ELSE c_mktsegment END AS career, '' AS level, CASE WHEN c_custkey % 4 = 0 THEN 'UGPA-RGI1-44-PRO-251-2025-12' ELSE '' END AS code,
 CASE WHEN c_custkey % 8 = 0 THEN '2024-01' WHEN c_custkey % 4 = 0 THEN '2025-12' ELSE '' END AS period, c_custkey % 4 = 0 OR c_custkey % 6 = 0 AS manual, CASE WHEN c_custkey % 4 = 0 THEN 'otra' ELSE 'Requiere confirmación manual.;otra' END AS remarks FROM customer"""


def agreement_corrections(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    store = c.select(k.alias("id"), F.lit("CGC-RGI2-1-PRO-134-2024-11").alias("code"), F.lit("2024-11").alias("period"), F.lit("").alias("option_id"), F.lit("").alias("plan_id"), F.col("c_mktsegment").alias("training"), F.lit(False).alias("linked"), F.lit(True).alias("total"), F.lit(False).alias("partial"), F.lit("").alias("percent"), F.lit(False).alias("manual"))
    edits = c.where("c_custkey % 3 = 0").select(k.alias("id"), F.concat(F.lit(" CGC-RGI2-2-PRO-134-"), F.lit("2025-0"), (k % 9 + 1).cast("string")).alias("code"), F.lit("").alias("period"), F.when(k % 2 == 0, F.concat(F.lit("o"), (k % 30).cast("string"))).otherwise("").alias("option_id"), F.lit("p").alias("plan_id"), F.lit(" typed ").alias("training"), F.lit("0").alias("total"), F.when(k % 5 == 0, "Sí").otherwise("no").alias("partial"), F.lit("12,5").alias("percent"))
    options = table(spark, d, "nation").select(F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("option_id"), F.col("n_nationkey").alias("plan_id"), F.col("n_name").alias("training"))
    return M.corrected_agreements(store, edits, options)


AGREEMENT_CORRECTIONS = """SELECT c_custkey AS id, CASE WHEN e THEN 'CGC-RGI2-2-PRO-134-2025-0' || (c_custkey % 9 + 1) ELSE 'CGC-RGI2-1-PRO-134-2024-11' END AS code, CASE WHEN e THEN '2025-0' || (c_custkey % 9 + 1) ELSE '2024-11' END AS period,
 CASE WHEN e AND c_custkey % 2 = 0 THEN 'o' || c_custkey % 30 ELSE '' END AS option_id, CASE WHEN NOT e THEN '' WHEN n_name IS NOT NULL THEN n_nationkey::VARCHAR ELSE 'p' END AS plan_id, CASE WHEN NOT e THEN c_mktsegment ELSE coalesce(n_name, 'typed') END AS training,
 e AND c_custkey % 2 = 0 AS linked, NOT e AS total, e AND c_custkey % 5 = 0 AS "partial", CASE WHEN e AND c_custkey % 5 = 0 THEN '12.5' ELSE '' END AS percent, e AS manual
FROM (SELECT *, c_custkey % 3 = 0 AS e FROM customer) LEFT JOIN nation ON e AND c_custkey % 2 = 0 AND n_nationkey = c_custkey % 30"""

# --- pages ---


def tsv_words(spark, d):
    """Lines of an order as an OCR engine puts them out; some lines are no words."""
    li = order_lines(spark, d)
    conf = F.when(F.col("p") % 5 == 0, "-1").when(F.col("p") % 7 == 0, "x").otherwise((F.col("p") % 100).cast("string"))
    line = F.concat_ws("\t", F.lit("5\t1\t1\t1"), F.col("l_linenumber").cast("string"), F.lit("1"), (F.col("p") % 500).cast("string"), (F.col("l_linenumber") * 20).cast("string"), F.lit("30\t12"), conf, F.when(F.col("p") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("w"), F.col("p").cast("string"))))
    pages = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("x"))
    tsv = F.concat(F.lit("level\tpage\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("\n1\t2\tshort"))
    words = G.tsv_words(pages.select(F.col("l_orderkey").alias("doc_id"), tsv.alias("tsv"), F.lit(10.0).alias("left"), F.lit(5.0).alias("top")))
    return words.select("doc_id", "line", "text", "left", "top", "right", "center_y", "confidence")


TSV_WORDS = f"""SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS line, 'w' || p AS text, (p % 500 + 10)::DOUBLE AS "left", (l_linenumber * 20 + 5)::DOUBLE AS top, (p % 500 + 40)::DOUBLE AS "right", (l_linenumber * 20 + 11)::DOUBLE AS center_y, CASE WHEN p % 5 = 0 THEN -1 ELSE p % 100 END::DOUBLE AS confidence
FROM ({ORDER_LINES}) WHERE p % 11 <> 0 AND (p % 5 = 0 OR p % 7 <> 0)"""


def row_anchors(spark, d):
    """Row numbers in the left margin; each may be read twice, the surer reading counts; other words lie further right."""
    li = order_lines(spark, d)
    y = F.col("l_linenumber") * 50.0
    word = lambda text, x, dy, conf: F.struct(text.alias("text"), F.lit(x).alias("center_x"), (y + dy).alias("center_y"), F.lit(x).alias("left"), conf.cast("double").alias("confidence"))
    words = F.array(word(F.col("l_linenumber").cast("string"), 30.0, 0.0, F.col("p") % 50), word(F.col("l_linenumber").cast("string"), 31.0, 9.0, F.col("p") % 60), word(F.lit("12"), 400.0, 0.0, F.lit(99)), word(F.lit("77"), 30.0, 20.0, F.lit(99)))
    pages = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1000.0).alias("page_width"), F.inline(words))
    return G.row_anchors(pages).select("doc_id", "number", "center_y", "confidence")


ROW_ANCHORS = f"""SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS number, l_linenumber * 50.0::DOUBLE + CASE WHEN p % 60 > p % 50 THEN 9 ELSE 0 END AS center_y, greatest(p % 50, p % 60)::DOUBLE AS confidence
FROM ({ORDER_LINES})"""


# --- end to end ---

_FORM = """concat('PLAN INDIVIDUAL DE FORMACIÓN Y CAPACITACIÓN DOCENTE\\n', 'Nombre del docente: ', {name}, '\\nCarrera: ', {career}, '\\nCódigo del documento: ', {code}, '\\n',
 '¿Qué herramientas tecnológicas utilizas regularmente en tu docencia?\\nAula ', {aula}, '\\n¿Cuál es tu nivel académico actual (título registrado)?\\nMagister en salud\\n',
 '4. Resumen de Capacitación Propuestas\\n1 Curso de redes ', {hours}, ' Desde 10 de marzo de 2025 hasta 20 de marzo de 2025 TALLER\\n2 Salud comunitaria ', {more}, ' Desde 1 de abril de 2025 hasta 5 de abril de 2025 CURSO\\n',
 '5. Indicadores\\n6. Actividades\\nActividades teóricas\\n- leer\\nActividades prácticas\\n- hacer\\n7. Impacto esperado en el docente\\nMejora la docencia\\n8. Visión a largo plazo\\nSer mejor')"""


def _readings(spark, d):
    """A customer's plan as three engines read it; the second misreads the name, the third the career and the hours; some pages are of another kind."""
    good = {"name": "c_name", "career": "'Enfermería'", "code": "concat('UGPA-RGI1-', lpad(cast(c_custkey % 150 + 1 as string), 2, '0'), '-PRO-251-2025-12')", "aula": "c_mktsegment", "hours": "cast(c_custkey % 40 + 1 as string)", "more": "'30'"}
    engines = {"DIGITAL_LINEAL": good, "DIGITAL_POSICIONAL": {**good, "name": "concat('x', c_name)", "aula": "''"}, "OCR_TEXTO": {**good, "career": "'Enfermeria'", "hours": "'7'", "code": good["code"].replace("PRO", "PR0")}}
    each = F.array(*(F.struct(F.lit(e).alias("engine"), F.lit(k).alias("seq"), F.when(F.col("c_custkey") % 10 == 9, F.repeat(F.lit("una carta sin formulario "), 5)).otherwise(F.expr(_FORM.format(**v))).alias("text")) for k, (e, v) in enumerate(engines.items())))
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("doc_id"), F.inline(each)).withColumns({"file_name": F.lit("plan.pdf"), "region_text": F.lit("")})


def process_plans(spark, d):
    """Flagship: three readings of every document parsed, reconciled field by field, validated."""
    out = P.processed_plans(_readings(spark, d), 2026)
    first = F.get("trainings", 0)
    return out.select("doc_id", "name", "career", "level", "code", "period", "template", F.col("diagnosis.herramientas_tecnologicas").alias("tools"), F.size("trainings").alias("n_trainings"), F.coalesce(first["hours"], F.lit(0.0)).cast("int").alias("hours"), F.array_join("practice", ";").alias("practice"), "vision", "status", "detail", "fallback")


PROCESS_PLANS = f"""WITH c AS (SELECT *, c_custkey % 10 <> 9 AS form, 'UGPA-RGI1-' || lpad((c_custkey % 150 + 1)::VARCHAR, 2, '0') || '-PRO-251-2025-12' AS code FROM customer)
SELECT c_custkey AS doc_id, CASE WHEN form THEN trim(c_name) ELSE '' END AS name, CASE WHEN form THEN 'Enfermería' ELSE '' END AS career, CASE WHEN form THEN 'Magister en salud' ELSE '' END AS level, CASE WHEN form THEN code ELSE '' END AS code, CASE WHEN form THEN '2025-12' ELSE '' END AS period,
 CASE WHEN form THEN 'MODERNA' ELSE 'DESCONOCIDA' END AS template, CASE WHEN form THEN 'Aula ' || c_mktsegment ELSE '' END AS tools, CASE WHEN form THEN 2 ELSE 0 END::INTEGER AS n_trainings, CASE WHEN form THEN c_custkey % 40 + 1 ELSE 0 END::INTEGER AS hours, CASE WHEN form THEN 'hacer' ELSE '' END AS practice, CASE WHEN form THEN 'Ser mejor' ELSE '' END AS vision,
 CASE WHEN form THEN 'REVISAR' ELSE 'NO_ES_PLAN' END AS status, CASE WHEN form THEN 'REVISAR_LECTURA' ELSE 'NO_ES_PLAN' END AS detail, true AS fallback FROM c"""

# --- agreements end to end, and what earlier versions ask for ---


def _agreement_readings(spark, d):
    """An agreement of every customer; some name their fields in clauses only, some are too short."""
    k = F.col("c_custkey")
    date = F.expr("concat('a los ', cast(c_custkey % 28 + 1 as string), ' días del mes de noviembre de 2024')")
    code = F.expr("concat('CGC-RGI2-', cast(c_custkey % 90 + 1 as string), '-PRO-134-2024-11')")
    labels = F.concat(F.lit("\nNombre del docente: "), F.col("c_name"), F.lit("\nCarrera: Derecho\nNombre de la capacitación: Curso de "), F.col("c_mktsegment"), F.lit("\n"))
    clauses = F.concat(F.lit("\nEl señor "), F.col("c_name"), F.lit(", con número de cédula 0102030405, solicita la participación de el colaborador en la capacitación Curso de "), F.col("c_mktsegment"), F.lit(", con el objetivo de mejorar.\n"))
    text = F.concat(F.lit("ACUERDO DE PATROCINIO INSTITUCIONAL\nCódigo: "), code, F.when(k % 2 == 0, labels).otherwise(clauses), F.when(k % 3 == 0, "Financiamiento total X\n").otherwise("Financiamiento total\n"), F.lit("En Quito, "), date, F.when(k % 5 == 0, ". Firmado electrónicamente.").otherwise("."))
    return spread(table(spark, d, "customer")).select(k.alias("doc_id"), F.when(k % 11 == 0, F.substring(text, 1, 60)).otherwise(text).alias("text"), F.lit("DIGITAL").alias("method"), F.lit("a.pdf").alias("file_name"))


def process_agreements(spark, d):
    options = table(spark, d, "customer").where("c_custkey % 4 <> 3").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit(":cap-0")).alias("option_id"), F.col("c_custkey").alias("plan_id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("teacher"), F.concat(F.lit("Curso de "), F.col("c_mktsegment")).alias("training"), F.lit("2024-11").alias("period"))
    out = P.processed_agreements(_agreement_readings(spark, d), options)
    return out.select("doc_id", "code", "period", "signed_on", F.lower("name").alias("name"), F.lower("training").alias("training"), "state", "signal", F.array_join("support", ",").alias("support"), "plan_id", "linked", F.size("issues").alias("n_issues"))


PROCESS_AGREEMENTS = """SELECT c_custkey AS doc_id, 'CGC-RGI2-' || (c_custkey % 90 + 1) || '-PRO-134-2024-11' AS code, '2024-11' AS period, '2024-11-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS signed_on, lower(c_name) AS name, lower('Curso de ' || c_mktsegment) AS training,
 CASE WHEN c_custkey % 5 = 0 THEN 'FIRMADO' ELSE 'PENDIENTE_FIRMA' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 6 END AS signal, CASE WHEN c_custkey % 3 = 0 THEN 'total' ELSE '' END AS support, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey::VARCHAR ELSE '' END AS plan_id, c_custkey % 4 <> 3 AS linked,
 (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 1 END + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN c_custkey % 4 = 3 THEN 2 ELSE 0 END)::INTEGER AS n_issues FROM customer WHERE c_custkey % 11 <> 0"""


def missing_fields(spark, d):
    k = F.col("o_orderkey")
    row = F.struct(F.lit("Redes").alias("name"), F.when(k % 3 == 0, 0.0).otherwise(40.0).alias("hours"), F.lit("a").alias("start"), F.when(k % 5 == 0, "").otherwise("b").alias("end"), F.lit("Taller").alias("kind"))
    plans = spread(table(spark, d, "orders")).select(
        k.alias("id"), F.when(k % 7 == 0, " ").otherwise("n").alias("name"), F.lit("c").alias("career"), F.lit("d").alias("dedication"), F.lit("l").alias("level"), F.when(k % 2 == 0, "x").otherwise("").alias("code"), F.when(k % 2 == 0, "p").alias("period"),
        F.struct(*(F.when(k % 13 == 0, F.lit("")).otherwise("r").alias(q) for q in DIAGNOSIS)).alias("diagnosis"), F.slice(F.array(row, row), F.lit(1), (k % 3).cast("int")).alias("trainings"), F.array(F.lit("leer")).alias("theory"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("hacer"))).alias("practice"), F.lit("i").alias("impact"), F.lit("v").alias("vision"),
    )
    return P.missing_fields(plans).select("id", F.size("missing").alias("n_missing"), "filled", "state")


MISSING_FIELDS = """WITH m AS (SELECT o_orderkey AS id, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END + CASE WHEN o_orderkey % 13 = 0 THEN 7 ELSE 0 END
 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE (o_orderkey % 3) * (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) END AS missing FROM orders)
SELECT id, missing::INTEGER AS n_missing, floor((13 + greatest(1, n * 9) - missing)::DOUBLE / (13 + greatest(1, n * 9)) * 100 + 0.5)::INTEGER AS filled, CASE WHEN missing > 0 THEN 'REVISAR' ELSE 'COMPLETO' END AS state FROM m"""

QUERIES = {
    "field_cleaners": (field_cleaners, FIELD_CLEANERS),
    "code_misread": (code_misread, CODE_MISREAD),
    "record_quality": (record_quality_query, RECORD_QUALITY),
    "useful_plans": (useful_plans, USEFUL_PLANS),
    "merge_records": (merge_records, _MERGED),
    "plan_upsert": (plan_upsert, PLAN_UPSERT),
    "plan_corrections": (plan_corrections, PLAN_CORRECTIONS),
    "agreement_corrections": (agreement_corrections, AGREEMENT_CORRECTIONS),
    "tsv_words": (tsv_words, TSV_WORDS),
    "row_anchors": (row_anchors, ROW_ANCHORS),
    "process_plans": (process_plans, PROCESS_PLANS),
    "process_agreements": (process_agreements, PROCESS_AGREEMENTS),
    "missing_fields": (missing_fields, MISSING_FIELDS),
}
