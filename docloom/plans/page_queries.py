"""Queries of extraction and page geometry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import plan_code
from ..operators import extraction as E
from ..operators import geometry as G
from ..shared import spread
from .common import ORDER_LINES, order_lines, sql_clean, sql_normalize, table


def line_explode(spark, d):
    lines = E.exploded_lines(spread(table(spark, d, "documents")), "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.max("pos").alias("last"))


LINE_EXPLODE = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars, (len(l) - 1)::INTEGER AS last FROM l WHERE len(l) > 0"""


def block_sessionize(spark, d):
    li = order_lines(spark, d)
    title = F.expr("CASE WHEN p % 4 = 0 THEN 'sin numero ' || p ELSE l_linenumber || '. curso ' || p END")
    more = F.concat(F.lit("sigue "), F.col("p").cast("string"))
    return E.blocks(li.select("l_orderkey", F.inline(F.array(F.struct((F.col("l_linenumber") * 2).alias("pos"), title.alias("line")), F.struct((F.col("l_linenumber") * 2 + 1).alias("pos"), more.alias("line"))))), "l_orderkey")


BLOCK_SESSIONIZE = f"""WITH g AS ({ORDER_LINES}),
r AS (SELECT l_orderkey, l_linenumber * 2 AS pos, CASE WHEN p % 4 = 0 THEN 'sin numero ' || p ELSE l_linenumber || '. curso ' || p END AS line, CASE WHEN p % 4 <> 0 THEN l_linenumber END AS o FROM g
 UNION ALL SELECT l_orderkey, l_linenumber * 2 + 1, 'sigue ' || p, NULL FROM g),
b AS (SELECT *, count(o) OVER (PARTITION BY l_orderkey ORDER BY pos) AS block FROM r)
SELECT l_orderkey, block, max(o)::INTEGER AS ordinal, string_agg(line, ' ' ORDER BY pos) AS text FROM b WHERE block > 0 GROUP BY l_orderkey, block"""

_KIND = "element_at(array('TALLER', 'CURSO', 'CERTIFICACIÓN', ''), cast(p % 4 + 1 as int))"


def _rows_text(spark, d):
    li = order_lines(spark, d)
    line = f"trim(l_linenumber || ' Redes y sistemas ' || translate(cast(p as string), '0123456789', 'abcdefghij') || ' ' || (p % 90 + 10) || ' Desde marzo ' || (2020 + p % 6) || ' hasta mayo ' || (2020 + p % 6) || ' ' || {_KIND})"
    return li.select("l_orderkey", "l_linenumber", "p", F.expr(line).alias("line"))


def table_rows(spark, d):
    r = _rows_text(spark, d).select("l_orderkey", "l_linenumber", E.table_row("line").alias("x"))
    return r.select("l_orderkey", "l_linenumber", "x.*")


TABLE_ROWS = f"""WITH g AS ({ORDER_LINES})
SELECT l_orderkey, l_linenumber, l_linenumber::INTEGER AS ordinal, 'Redes y sistemas ' || translate(p::VARCHAR, '0123456789', 'abcdefghij') AS name, (p % 90 + 10)::INTEGER AS hours,
 'marzo ' || (2020 + p % 6) AS "start", 'mayo ' || (2020 + p % 6) AS "end", ['TALLER', 'CURSO', 'CERTIFICACIÓN', ''][p % 4 + 1] AS kind FROM g"""


def inline_rows(spark, d):
    text = _rows_text(spark, d).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), " ").alias("t"))
    rows = text.select("l_orderkey", F.explode(E.inline_rows("t")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("x.hours").alias("hours"), F.sum("x.ordinal").alias("ordinals"))


INLINE_ROWS = f"""WITH g AS ({ORDER_LINES})
SELECT l_orderkey, count(*) AS n, sum(p % 90 + 10)::BIGINT AS hours, sum(l_linenumber)::BIGINT AS ordinals FROM g GROUP BY l_orderkey"""


def _form(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("doc_id"),
        F.concat_ws(
            "\n", F.lit("PLAN INDIVIDUAL"), F.when(c % 3 == 0, F.concat(F.lit("Nombre del docente: "), "c_name")).otherwise(F.concat(F.lit("NOMBRE DEL DOCENTE:\n"), "c_name")), F.concat(F.lit("Carrera "), "c_mktsegment"),
            F.lit("4. Resumen"), F.concat(F.lit("tabla "), c.cast("string")), F.when(c % 2 == 0, "6. Actividades uno").otherwise("5. Indicadores dos"), F.lit("5. Indicador tres"), F.lit("¿Qué hizo?"), F.concat(F.lit("nada "), c.cast("string")), F.lit("¿Qué hará?"), F.lit("todo"),
        ).alias("text"),
    )


def label_value(spark, d):
    return _form(spark, d).select("doc_id", E.label_value("text", "nombre del docente", ("carrera",)).alias("name"), E.label_value("text", "carrera").alias("career"))


LABEL_VALUE = "SELECT c_custkey AS doc_id, c_name AS name, c_mktsegment AS career FROM customer"


def section_extract(spark, d):
    return _form(spark, d).select("doc_id", E.section("text", r"4\. resumen", (r"5\. indicador", r"6\. actividad")).alias("nearest"), F.length(E.table_section("text", r"4\. resumen", r"5\. indicador", r"6\. actividad")).alias("preferred"))


SECTION_EXTRACT = """SELECT c_custkey AS doc_id, chr(10) || 'tabla ' || c_custkey || chr(10) AS nearest, CASE WHEN c_custkey % 2 = 0 THEN length(chr(10) || 'tabla ' || c_custkey || chr(10) || '6. Actividades uno' || chr(10)) ELSE length(chr(10) || 'tabla ' || c_custkey || chr(10)) END::INTEGER AS preferred FROM customer"""


def question_answers(spark, d):
    found = E.answers("text", {"did": r"¿que hizo\?", "will": r"¿que hara\?"})
    return _form(spark, d).select("doc_id", found["did"].alias("did"), found["will"].alias("will"))


QUESTION_ANSWERS = "SELECT c_custkey AS doc_id, 'nada ' || c_custkey AS did, 'todo' AS will FROM customer"


def activity_list(spark, d):
    text = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'leer ' || p_name || '; escribir' ELSE 'Actividades teóricas\n• leer ' || p_name || '\n 2) hacer ' || p_type END")
    return table(spark, d, "part").select("p_partkey", F.array_join(E.activities(text), "|").alias("items"))


ACTIVITY_LIST = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'leer ' || p_name || '|escribir' ELSE 'leer ' || p_name || '|hacer ' || p_type END AS items FROM part"


def flag_lookahead(spark, d):
    c = F.col("c_custkey")
    text = F.concat_ws("\n", F.lit("Permiso para asistir"), F.when(c % 2 == 0, "X").otherwise("-"), F.lit("Financiamiento total ( )"), F.lit("nota"), F.when(c % 3 == 0, "marcar: x").otherwise("vacío"), F.lit("Viáticos"), F.lit("Compromisos"), F.lit("x"))
    return E.support_flags(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey")


FLAG_LOOKAHEAD = "SELECT c_custkey, 'permiso' AS flag FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'total' FROM customer WHERE c_custkey % 3 = 0"


#: Covers and codes put before, into or behind a document's whole text.
_COVERS = """CASE doc_id % 10
 WHEN 0 THEN text || '\n Código del documento'
 WHEN 1 THEN 'PLAN INDIVIDUAL DE FORMACIÓN\nY CAPACITACIÓN DOCENTE\nDOCENTE: ' || text
 WHEN 2 THEN 'Plan individual de formación\ny capacitación\ndocente: ' || text
 WHEN 3 THEN text || '\nPlan individual de capacitacion docente'
 WHEN 4 THEN 'PLAN INDIVIDUAL CAPACITACION DOCENTE : x PLAN INDIVIDUAL Y CAPACITACIÓN DOCENTE ' || text
 WHEN 5 THEN 'PLAN INDIVIDUAL ' || repeat('y ', cast(doc_id % 60 + 60 as int)) || 'CAPACITACIÓN  DOCENTE  : ' || text
 WHEN 6 THEN text || ' UGPA-RGI1-01-PRO-251-2025-10 '
 WHEN 7 THEN 'código : ' || text
 WHEN 8 THEN 'codigos, PLAN INDIVIDUAL DOCENTE: ' || text
 ELSE text END"""


def template_detect(spark, d):
    """Templates of covers and codes anywhere in whole texts."""
    text = F.expr(_COVERS)
    return spread(table(spark, d, "documents")).select("doc_id", E.template_of(text, plan_code(text)).alias("template"))


# without look-ahead: the first letter of a legacy title's last word is masked, what is left of the title is modern
_SQL_TITLE = "plan\\s+individual[\\s\\S]{0,180}?capacitaci[oó]n\\s+docente"
TEMPLATE_DETECT = f"""WITH t AS (SELECT doc_id, {sql_clean(_COVERS.replace("'\\n", "chr(10) || '").replace("\\n", "' || chr(10) || '").replace("as int", "as integer"))} AS t FROM documents),
c AS (SELECT doc_id, t, lower(substr(t, 1, 2400)) AS cover FROM t)
SELECT doc_id, CASE WHEN regexp_matches(t, 'UGPA-RGI1-01-PRO-251-2025-10([^0-9]|$)') OR contains(' ' || {sql_normalize('t')} || ' ', ' codigo ') THEN 'MODERNA'
 WHEN regexp_matches(regexp_replace(cover, '(capacitaci[oó]n\\s+)d(ocente\\s*:)', '\\1#\\2', 'g'), '{_SQL_TITLE}') THEN 'MODERNA' WHEN regexp_matches(cover, '{_SQL_TITLE}\\s*:') THEN 'ANTIGUA' ELSE 'DESCONOCIDA' END AS template FROM c"""


# --- word boxes: each order is a page, its lines are rows of words ---


def _words(spark, d):
    li = order_lines(spark, d)
    spots = F.expr("array(named_struct('text', cast(l_linenumber as string), 'left', 30.0d), named_struct('text', 'curso', 'left', 120.0d), named_struct('text', cast(p as string), 'left', 300.0d), named_struct('text', '40', 'left', 500.0d), named_struct('text', '2025', 'left', 620.0d), named_struct('text', 'TALLER', 'left', 850.0d))")
    w = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), "p", F.posexplode(spots).alias("word", "x"))
    boxes = w.select("doc_id", "page", F.lit(1).alias("block"), F.lit(1).alias("paragraph"), "line", "word", "x.text", "x.left", (F.col("line") * 60.0 + F.col("word") % 3).alias("top"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"), F.lit(90.0).alias("confidence"), F.lit(1000.0).alias("page_width"), F.lit(560.0).alias("page_height"))
    return G.with_box(boxes)


_WORDS = f"""w AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, p, word, [l_linenumber::VARCHAR, 'curso', p::VARCHAR, '40', '2025', 'TALLER'][word + 1] AS text, [30.0::DOUBLE, 120.0, 300.0, 500.0, 620.0, 850.0][word + 1] AS "left", l_linenumber * 60.0::DOUBLE + word % 3 AS top
 FROM ({ORDER_LINES}), (SELECT unnest(range(6)) AS word))"""


def words_in_region(spark, d):
    words = _words(spark, d)
    regions = words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("table").alias("region"), F.lit(100.0).alias("left"), F.lit(100.0).alias("top"), F.lit(420.0).alias("width"), F.lit(140.0).alias("height"))
    inside = G.words_inside(words, regions)
    return inside.groupBy("doc_id", "region").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


WORDS_IN_REGION = f"""WITH {_WORDS} SELECT doc_id, 'table' AS region, count(*) AS n, max(line) AS last_line FROM w WHERE "left" + 10 BETWEEN 100 AND 520 AND top + 5 BETWEEN 100 AND 240 GROUP BY doc_id"""


def line_grouping(spark, d):
    return G.ocr_lines(_words(spark, d)).select("doc_id", "line", "text", "left", "top", "right", "bottom", "n_words")


LINE_GROUPING = f"""WITH {_WORDS} SELECT doc_id, line, string_agg(text, ' ' ORDER BY "left") AS text, min("left") AS "left", min(top) AS top, max("left" + 20) AS "right", max(top + 10) AS bottom, count(*) AS n_words FROM w GROUP BY doc_id, line"""


def visual_lines(spark, d):
    return G.line_text(G.visual_lines(_words(spark, d), 12.0)).select("doc_id", "visual_line", "text")


VISUAL_LINES = f"""WITH {_WORDS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::INTEGER AS visual_line, text FROM (SELECT doc_id, line, string_agg(text, ' ' ORDER BY "left") AS text FROM w GROUP BY doc_id, line)"""


def column_split(spark, d):
    words = _words(spark, d)
    return words.groupBy(G.column_of(F.col("center_x") / F.col("page_width")).alias("cell")).agg(F.count("*").alias("n"))


COLUMN_SPLIT = f"""WITH {_WORDS} SELECT CASE WHEN r <= 0.085 THEN 'number' WHEN r <= 0.445 THEN 'name' WHEN r <= 0.585 THEN 'hours' WHEN r <= 0.775 THEN 'date' ELSE 'type' END AS cell, count(*) AS n FROM (SELECT ("left" + 10) / 1000 AS r FROM w) GROUP BY 1"""


def table_cells(spark, d):
    return G.table_cells(_words(spark, d)).select("doc_id", "ordinal", "number", "name", "hours", "date", "type")


TABLE_CELLS = f"""SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, l_linenumber::VARCHAR AS number, 'curso ' || p AS name, '40' AS hours, '2025' AS date, 'TALLER' AS type FROM ({ORDER_LINES})"""


QUERIES = {
    "line_explode": (line_explode, LINE_EXPLODE),
    "block_sessionize": (block_sessionize, BLOCK_SESSIONIZE),
    "table_rows": (table_rows, TABLE_ROWS),
    "inline_rows": (inline_rows, INLINE_ROWS),
    "label_value": (label_value, LABEL_VALUE),
    "section_extract": (section_extract, SECTION_EXTRACT),
    "question_answers": (question_answers, QUESTION_ANSWERS),
    "activity_list": (activity_list, ACTIVITY_LIST),
    "flag_lookahead": (flag_lookahead, FLAG_LOOKAHEAD),
    "template_detect": (template_detect, TEMPLATE_DETECT),
    "words_in_region": (words_in_region, WORDS_IN_REGION),
    "line_grouping": (line_grouping, LINE_GROUPING),
    "visual_lines": (visual_lines, VISUAL_LINES),
    "column_split": (column_split, COLUMN_SPLIT),
    "table_cells": (table_cells, TABLE_CELLS),
}
