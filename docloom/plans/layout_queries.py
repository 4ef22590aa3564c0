"""Queries of page layout, row scores, line kinds and record keys over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaners as C
from ..functions.quality import positional_signal_of_key, usable_layer
from ..functions.text import clean, display, normalize, split_list
from ..operators import extraction as E
from ..operators import geometry as G
from ..operators import layout as L
from ..operators import validation as V
from ..operators.processing import error_plans, question_answers, section_activities
from ..shared import spread
from ..sources.files import split_failures
from .common import ORDER_LINES, order_lines, sql_clean, sql_compact, sql_normalize, sql_tokens, table
from .page_queries import _rows_text
from .record_queries import _sql_issues, _validated
from .text_queries import sql_aliases


def _newlines(expression: str) -> str:
    """An expression of literals with \\n, for DuckDB."""
    return expression.replace("\\n", "' || chr(10) || '")


# --- text items of a page ---

_ITEM = "CASE p % 4 WHEN 0 THEN 'curso  de' || chr(9) || p WHEN 1 THEN ' Redes y sistemas de computo ' || p WHEN 2 THEN cast(p as varchar(20)) ELSE '  ' END"


def text_items(spark, d):
    """An order's lines as text items: wide and narrow ones, low ones, mirrored ones, blank ones."""
    n = F.col("p")
    items = order_lines(spark, d).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("run"), F.expr(_ITEM.replace("varchar(20)", "string").replace("chr(", "char(")).alias("text"), (n % 7 + 40).cast("double").alias("x"), (800 - F.col("l_linenumber") * 120).cast("double").alias("baseline"),
        (n % 200).cast("double").alias("width"), F.when(n % 3 == 0, 2.0).when(n % 3 == 1, -12.0).alias("height"), F.lit(842.0).alias("page_height"),
    )
    boxes = G.split_runs(G.item_runs(items))
    return boxes.select("doc_id", "run", "pos", "text", *(F.round(c, 4).alias(c) for c in ("left", "top", "width", "height", "center_x")))


TEXT_ITEMS = f"""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS run, trim(regexp_replace({_ITEM}, '\\s+', ' ', 'g')) AS t, (p % 7 + 40)::DOUBLE AS x, (800 - l_linenumber * 120)::DOUBLE AS baseline, (p % 200)::DOUBLE AS given, CASE p % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 12.0 ELSE 10.0 END::DOUBLE AS height FROM ({ORDER_LINES})),
u AS (SELECT *, greatest(given, length(t) * greatest(3.0::DOUBLE, height * 0.38::DOUBLE)) / length(t) AS unit FROM i WHERE t <> ''),
w AS (SELECT *, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS k FROM u),
s AS (SELECT *, greatest(2.0::DOUBLE, unit * length(word)) AS size FROM w),
b AS (SELECT *, x + coalesce(sum(size + unit) OVER (PARTITION BY doc_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM s)
SELECT doc_id, run, (k - 1)::INTEGER AS pos, word AS text, round(x0, 4) AS "left", round(greatest(0.0::DOUBLE, 842 - baseline - height), 4) AS top, round(size, 4) AS width, round(height, 4) AS height, round(x0 + size / 2, 4) AS center_x FROM b"""


# --- scores of whole texts as pages ---

_PAGE_TEXT = """CASE doc_id % 6
 WHEN 0 THEN text || ' 1 Curso de redes 40 horas Desde marzo hasta abril Aprobación 2 Taller 1200 h desde mayo aprobacion'
 WHEN 1 THEN 'Actividades teóricas y prácticas. ' || text
 WHEN 2 THEN 'Plan Individual de Formación y Capacitación PRO-251. Nombre docente ' || text
 WHEN 3 THEN text || ' plan individual; formación; capacitación propuesta; visión a largo plazo; docente, carrera; pro 251'
 WHEN 4 THEN 'RESUMEN DE CAPACITACIÓN ' || text || ' Impacto esperado' ELSE text END"""


def page_scores(spark, d):
    """Scores of whole texts; each text is cleaned and normalized once for all of them."""
    texts = spread(table(spark, d, "documents")).select("doc_id", F.expr(_PAGE_TEXT).alias("x"))
    rows = texts.select("doc_id", clean("x").alias("x"), normalize("x").alias("key"))
    x, key = F.col("x"), F.col("key")
    signal = positional_signal_of_key(key)
    return rows.select("doc_id", L.table_score_of_key(key, L.word_count(x)).alias("table_score"), F.round(L.activity_score_of_key(key), 6).alias("activity_score"), C.key_looks_like_table(key).alias("is_table"), signal.alias("signal"), usable_layer(F.length(x), signal).alias("usable"))


_TABLE_MONTHS = "'enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'"
_TABLE_KINDS = "'aprobacion', 'certificacion', 'asistencia', 'curso', 'taller', 'seminario', 'congreso', 'diplomado'"
PAGE_SCORES = f"""WITH x AS (SELECT doc_id, {_PAGE_TEXT} AS x FROM documents), k AS (SELECT doc_id, {sql_clean('x')} AS c, {sql_normalize('x')} AS k FROM x),
t AS (SELECT *, string_split(k, ' ') AS w FROM k),
n AS (SELECT *, len(list_filter(w[:-2], lambda y: regexp_full_match(y, '[0-9]{{1,2}}'))) AS numbers, len(list_filter(w, lambda y: regexp_full_match(y, '[0-9]{{1,4}}'))) AS hours,
 len(list_filter(w, lambda y: y IN ('desde', 'hasta', {_TABLE_MONTHS}))) AS dates, len(list_filter(w, lambda y: y IN ({_TABLE_KINDS}))) AS kinds,
 len(list_filter(w, lambda y: y = 'desde')) AS ranges, len(list_filter(w, lambda y: y = 'aprobacion')) AS passed, len(regexp_extract_all(c, '\\S+')) AS words,
 CASE WHEN contains(k, 'plan individual de formacion y capacitacion') THEN 4 WHEN contains(k, 'plan individual') AND contains(k, 'formacion') THEN 2 ELSE 0 END + CASE WHEN contains(k, 'pro 251') THEN 3 ELSE 0 END
 + CASE WHEN contains(k, 'nombre docente') OR contains(k, 'docente') AND contains(k, 'carrera') THEN 1 ELSE 0 END + CASE WHEN contains(k, 'resumen de capacitacion') OR contains(k, 'capacitacion propuesta') THEN 2 ELSE 0 END
 + CASE WHEN contains(k, 'impacto esperado') OR contains(k, 'vision a largo plazo') THEN 1 ELSE 0 END AS signal FROM t)
SELECT doc_id, CASE WHEN k = '' THEN 0.0 ELSE numbers * 4 + kinds * 5 + dates * 2 + least(12, hours) + least(15.0::DOUBLE, words / 8) END::DOUBLE AS table_score,
 round(CASE WHEN k = '' THEN 0.0 ELSE least(20.0::DOUBLE, length(k) / 30) + CASE WHEN contains(k, 'teorica') THEN 8 ELSE 0 END + CASE WHEN contains(k, 'practica') THEN 8 ELSE 0 END END::DOUBLE, 6) AS activity_score,
 contains(k, 'resumen de capacitacion') OR contains(k, 'capacitacion propuesta') OR ranges >= 2 AND passed >= 2 AS is_table, signal::INTEGER AS signal, length(c) >= 550 AND signal >= 5 AS usable FROM n"""


# --- regions of a page by its lines ---

_PAGE_LINE = """CASE p % 9 WHEN 0 THEN '4. Resumen de Capacitación Propuesta' WHEN 1 THEN '5. Indicadores' WHEN 2 THEN '6. Actividades' WHEN 3 THEN '7. Impacto esperado en el docente'
 WHEN 4 THEN 'Visión a largo plazo (3 a 5 años)' WHEN 5 THEN 'Formación Docente' WHEN 6 THEN 'Capacitación propuesta, horas' WHEN 7 THEN 'Propuesta de capacitación: resumen' ELSE 'curso ' || p END"""


def page_sections(spark, d):
    """The regions that the headings among an order's lines open and close."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = order_lines(spark, d).select(o.alias("doc_id"), (o % 3 + 1).cast("int").alias("page"), (o % 5 * 10 + 1000).cast("double").alias("page_width"), F.lit(560.0).alias("page_height"), F.expr(_PAGE_LINE).alias("text"), (n * 60).cast("double").alias("top"), (n * 60 + 10).cast("double").alias("bottom"))
    return G.page_regions(lines).select("doc_id", "page", "region", *(F.round(c, 4).alias(c) for c in ("left", "top", "width", "height")))


_SECTIONS = {
    "table": ("contains(k, 'resumen') AND contains(k, 'capacitacion') AND contains(k, 'propuesta')", "contains(k, 'indicadores')"),
    "activities": ("contains(' ' || k || ' ', ' 6 actividades ') OR k = 'actividades'", "contains(k, '7 impacto esperado') OR contains(k, 'impacto esperado en el docente')"),
    "impact": ("contains(k, '7 impacto esperado') OR contains(k, 'impacto esperado en el docente')", "contains(k, 'vision a largo plazo') OR contains(k, '8 vision')"),
    "vision": ("contains(k, 'vision a largo plazo') OR contains(k, '8 vision')", "contains(k, 'formacion docente')"),
}


def _sql_section(name: str, start: str, end: str) -> str:
    return f"""SELECT doc_id, page, '{name}' AS region, w * 0.02 AS "left", greatest(0, b - 13) AS top, w * 0.96 AS width, greatest(20, least(560, coalesce(e + 2, b + 252)) - greatest(0, b - 13)) AS height
 FROM (SELECT doc_id, page, w, b, (SELECT min(top) FROM l z WHERE z.doc_id = s.doc_id AND z.top > s.b AND ({end})) AS e FROM (SELECT doc_id, page, w, min(top) + 10 AS b FROM l WHERE {start} GROUP BY ALL) s)"""


PAGE_SECTIONS = f"""WITH g AS (SELECT l_orderkey AS doc_id, l_orderkey % 3 + 1 AS page, (l_orderkey % 5 * 10 + 1000)::DOUBLE AS w, {_PAGE_LINE} AS t, (l_linenumber * 60)::DOUBLE AS top FROM ({ORDER_LINES})),
l AS (SELECT *, {sql_normalize('t')} AS k FROM g), found AS ({' UNION ALL '.join(_sql_section(name, *marks) for name, marks in _SECTIONS.items())}),
p AS (SELECT doc_id, page, w, bool_or(contains(k, 'capacitacion propuesta')) AND bool_or(contains(k, 'horas')) AS titled FROM l GROUP BY ALL),
a AS (SELECT * FROM found UNION ALL SELECT doc_id, page, 'header', 0, 0, w, 123.2 FROM p WHERE page <= 2 UNION ALL SELECT doc_id, page, 'code', w * 0.48, 0, w * 0.52, 134.4 FROM p WHERE page <= 2
 UNION ALL SELECT doc_id, page, 'table', w * 0.02, 22.4, w * 0.96, 358.4 FROM p WHERE titled AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = p.doc_id AND f.region = 'table'))
SELECT doc_id, page::INTEGER AS page, region, round("left"::DOUBLE, 4) AS "left", round(top::DOUBLE, 4) AS top, round(width::DOUBLE, 4) AS width, round(height::DOUBLE, 4) AS height FROM a"""


def header_corner(spark, d):
    """Words in the upper right corner of first pages; every line has a word there and one elsewhere."""
    o = F.col("l_orderkey")
    spots = F.array(F.struct(F.lit("curso").alias("text"), F.lit(100.0).alias("left")), F.struct(F.concat(F.lit("P"), F.col("p").cast("string")).alias("text"), (F.lit(660.0) + F.col("p") % 40).alias("left")))
    words = order_lines(spark, d).select(o.alias("doc_id"), (o % 2 + 1).cast("int").alias("page"), "l_linenumber", F.inline(spots)).withColumns({"top": (F.col("l_linenumber") * 30).cast("double"), "width": F.lit(20.0), "height": F.lit(10.0), "page_width": F.lit(1000.0), "page_height": F.lit(560.0)})
    return G.header_corner(G.with_box(words)).select("doc_id", "text")


HEADER_CORNER = f"""SELECT l_orderkey AS doc_id, string_agg('P' || p, ' ' ORDER BY l_linenumber) AS text FROM ({ORDER_LINES}) WHERE l_orderkey % 2 = 0 AND 660 + p % 40 + 10 >= 680 AND l_linenumber * 30 + 5 <= 560 * 0.23 GROUP BY l_orderkey"""


def clamped_regions(spark, d):
    """Rectangles that leave their page, and rectangles given as shares of it."""
    p = {k: F.expr(f"cast({v} as double)").alias(k) for k, v in _BOX.items()}
    rows = table(spark, d, "part").select("p_partkey", *p.values())
    box, share = L.clamped(*(F.col(k) for k in _BOX)), L.by_ratio(F.col("page_width"), F.col("page_height"), 0.25, 0.125, 0.5, 0.75)
    return rows.select("p_partkey", box.alias("b"), share.alias("r")).select("p_partkey", "b.*", F.col("r.left").alias("share_left"), F.col("r.top").alias("share_top"), F.col("r.width").alias("share_width"), F.col("r.height").alias("share_height"))


_BOX = {"left": "p_partkey % 300 - 100", "top": "p_partkey % 170 - 60", "width": "p_partkey % 90 - 5", "height": "p_partkey % 70", "page_width": "100 + p_size", "page_height": "50 + p_size"}
CLAMPED_REGIONS = f"""WITH r AS (SELECT p_partkey, {', '.join(f'({v})::DOUBLE AS b_{k}' for k, v in _BOX.items())} FROM part),
c AS (SELECT *, CASE WHEN b_left < 0 THEN 0 WHEN b_left > b_page_width - 1 THEN b_page_width - 1 ELSE b_left END AS x, CASE WHEN b_top < 0 THEN 0 WHEN b_top > b_page_height - 1 THEN b_page_height - 1 ELSE b_top END AS y FROM r)
SELECT p_partkey, x AS "left", y AS top, greatest(1, least(b_width, b_page_width - x)) AS width, greatest(1, least(b_height, b_page_height - y)) AS height, b_page_width / 4 AS share_left, b_page_height / 8 AS share_top, b_page_width / 2 AS share_width, b_page_height * 3 / 4 AS share_height FROM c"""


# --- activities of a section and the trainings that they belong to ---


def _topic(p: str) -> str:
    return f"CASE {p} % 8 WHEN 0 THEN 'hacking etico' WHEN 1 THEN 'inteligencia y datos' WHEN 2 THEN 'normas APA' WHEN 3 THEN 'fibra optica' WHEN 4 THEN 'software libre' WHEN 5 THEN 'seguridad con ia' WHEN 6 THEN 'redes ' || {p} ELSE 'tema ' || ({p} % 50) END"


def activity_assignment(spark, d):
    """An order's lines are the trainings of a plan; its odd lines name theoretical activities, the even ones practical ones."""
    li = order_lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("n"), F.expr(f"'Curso: ' || {_topic('p')}").alias("name"), F.expr(f"CASE WHEN l_linenumber % 2 = 1 THEN '- estudiar ' ELSE '• aplicar ' END || {_topic('(p + 1)')}").alias("item"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "name", "item"))).alias("r"))
    part = lambda odd: F.array_join(F.transform(F.filter("r", lambda x: x["n"] % 2 == odd), lambda x: x["item"]), "\n")
    listed = rows.select("l_orderkey", "r", section_activities(F.concat(F.lit("6. Actividades\nTeóricas\n"), part(1), F.lit("\nPrácticas\n"), part(0))).alias("listed"))
    out = listed.select("l_orderkey", F.posexplode(L.training_activities(F.col("r"), F.col("listed"))).alias("pos", "x"))
    return out.select("l_orderkey", (F.col("pos") + 1).alias("l_linenumber"), F.array_join("x.theory", "|").alias("theory"), F.array_join("x.practice", "|").alias("practice"), "x.shared")


ACTIVITY_ASSIGNMENT = f"""WITH g AS (SELECT l_orderkey AS o, l_linenumber AS n, 'Curso: ' || {_topic('p')} AS name, l_linenumber % 2 = 1 AS odd, CASE WHEN l_linenumber % 2 = 1 THEN 'estudiar ' ELSE 'aplicar ' END || {_topic('(p + 1)')} AS item FROM ({ORDER_LINES})),
i AS (SELECT o, odd, item, min(n) AS pos, {sql_aliases(sql_tokens('item', 1), L.ACTIVITY_ALIASES)} AS w FROM g GROUP BY o, odd, item),
a AS (SELECT o, odd, string_agg(item, '|' ORDER BY pos) AS items FROM i GROUP BY o, odd),
t AS (SELECT o, n, {sql_aliases(sql_tokens('name', 1), L.ACTIVITY_ALIASES)} AS w FROM g),
p AS (SELECT t.o, t.n, odd, item, pos, coalesce(list_sum(list_transform(list_intersect(t.w, i.w), lambda y: CASE WHEN length(y) <= 2 THEN 1 ELSE 2 END)), 0) AS score FROM t JOIN i USING (o)),
b AS (SELECT o, n, odd, arg_max(item, score * 100 - pos) FILTER (score > 0) AS item FROM p GROUP BY o, n, odd)
SELECT t.o AS l_orderkey, t.n::INTEGER AS l_linenumber, coalesce(x.item, xa.items, '') AS theory, coalesce(y.item, ya.items, '') AS practice, x.item IS NULL OR y.item IS NULL AS shared
FROM t LEFT JOIN b x ON x.o = t.o AND x.n = t.n AND x.odd LEFT JOIN b y ON y.o = t.o AND y.n = t.n AND NOT y.odd LEFT JOIN a xa ON xa.o = t.o AND xa.odd LEFT JOIN a ya ON ya.o = t.o AND NOT ya.odd"""


# --- lines, rows, records ---

_FORM_LINES = "CASE doc_id % 3 WHEN 0 THEN text || '\\nHoras de  Capacitación Propuesta\\n4.1) Datos\\n• ¿Qué hizo?\\nIndicadores de logro\\nY qué estrategias usas\\n---' WHEN 1 THEN 'Propuesta de\\n12 Redes\\n' || text ELSE text END"
_FILE = "CASE doc_id % 5 WHEN 0 THEN 'ugplan~' || doc_id || '.pdf' WHEN 1 THEN 'UGPLANES.PDF' WHEN 2 THEN 'UG~1.PDF' WHEN 3 THEN 'UGLARGO' || doc_id || '0000.PDF' ELSE 'plan ' || doc_id || '.pdf' END"


def line_kinds(spark, d):
    """How many lines of whole texts are column headings, begin a section, or ask a question; whether the file's name is a short alias."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.expr(_FILE).alias("file"), F.expr(_FORM_LINES).alias("text"))
    count = lambda c: F.count_if(c)
    lines = docs.select("doc_id", C.is_alias_file("file").alias("alias"), F.explode(E.lines("text")).alias("line"))
    return lines.groupBy("doc_id").agg(F.first("alias").alias("alias"), F.count("*").alias("n"), count(C.is_table_heading("line")).alias("headings"), count(C.is_section_heading("line")).alias("sections"), count(C.is_question("line", ("que estrategias",))).alias("questions"))


_HEADINGS = "'', 'nombre de capacitacion propuesta', 'horas de capacitacion propuesta', 'fecha de propuesta de ejecucion', 'tipo de capacitacion propuesta', 'nombre de', 'capacitacion', 'propuesta', 'horas de', 'fecha de', 'propuesta de', 'ejecucion', 'tipo de capacitacion'"
_TITLES = "evaluaciones de capacitacion|resumen de capacitacion propuestas|indicadores|actividades|formacion docente|impacto esperado en el docente|vision a largo plazo"
LINE_KINDS = rf"""WITH x AS (SELECT doc_id, upper({_FILE}) AS f, {_newlines(_FORM_LINES)} AS x FROM documents),
l AS (SELECT doc_id, f, unnest(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[\s\x{{00A0}}]', ' ', 'g'))), lambda y: y <> '')) AS y FROM x), k AS (SELECT *, {sql_normalize('y')} AS k FROM l)
SELECT doc_id, regexp_full_match(any_value(f), 'UG([A-Z0-9]{{3,8}}~[0-9]+|[A-Z0-9]{{4,10}})\.PDF') AS alias, count(*) AS n, count(*) FILTER (k IN ({_HEADINGS})) AS headings,
 count(*) FILTER (regexp_matches(y, '^[0-9]+(\.[0-9]+)*[.)]?\s+') OR regexp_matches(k, '^({_TITLES})( |$)')) AS sections, count(*) FILTER (regexp_matches(y, '^[•▪◦●■□◆◇▶►\-–—*]*\s*[¿?]') OR contains(k, 'que estrategias')) AS questions FROM k GROUP BY doc_id"""


def row_readings(spark, d):
    """Two readings of an order's rows: one loses the kind of some rows, the other some rows; which counts by completeness, and which as cells of a region."""
    rows = _rows_text(spark, d).select("l_orderkey", "l_linenumber", "p", E.table_row("line").alias("a"))
    both = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "a"))).alias("r"))
    first, second = F.transform("r", lambda x: x["a"]), F.transform(F.filter("r", lambda x: x["p"] % 5 != 0), lambda x: x["a"].withField("kind", F.lit("TALLER")))
    out = both.select("l_orderkey", E.best_rows(first, second).alias("best"), E.fuller_rows(first, second).alias("fuller"))
    filled = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + E.filled_cells(x))
    return out.select("l_orderkey", F.size("best").alias("best_rows"), filled("best").alias("best_cells"), F.size("fuller").alias("fuller_rows"), filled("fuller").alias("fuller_cells"))


ROW_READINGS = f"""WITH n AS (SELECT l_orderkey, count(*) AS a, count(*) * 4 + count(*) FILTER (p % 4 <> 3) AS fa, count(*) FILTER (p % 5 <> 0) AS b, 5 * count(*) FILTER (p % 5 <> 0) AS fb FROM ({ORDER_LINES}) GROUP BY l_orderkey),
w AS (SELECT *, fb + 10 * b > fa + 10 * a AS best_b, b > 0 AND (b > a OR fb > fa) AS fuller_b FROM n)
SELECT l_orderkey, CASE WHEN best_b THEN b ELSE a END::INTEGER AS best_rows, CASE WHEN best_b THEN fb ELSE fa END::INTEGER AS best_cells, CASE WHEN fuller_b THEN b ELSE a END::INTEGER AS fuller_rows, CASE WHEN fuller_b THEN fb ELSE fa END::INTEGER AS fuller_cells FROM w"""

_CODE = "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' - ' ELSE 'UGPA-RGI1-' || c_custkey END"
_SHOWN = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE '  ' || c_name || ' ' END"
_TYPED = "CASE c_custkey % 4 WHEN 0 THEN '-5' WHEN 1 THEN 'doce' WHEN 2 THEN NULL ELSE c_custkey || '.5' END"


def record_keys(spark, d):
    """Keys of records in a list, shown values, and training rows typed by hand."""
    items = F.concat(F.lit("leer | "), F.col("c_name"), F.lit("\n \n| "), F.col("c_mktsegment"))
    typed = L.manual_training(F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")), F.expr(_TYPED), F.lit(" marzo"), F.lit(None).cast("string"), F.col("c_mktsegment"), items, F.lit(" | "))
    return table(spark, d, "customer").select(
        "c_custkey", L.record_key(F.col("c_name"), F.expr(_CODE), F.expr("'Plan_' || c_custkey || '.pdf'")).alias("key"), display(F.expr(_SHOWN), "Sin dato").alias("shown"), F.array_join(split_list(items), ";").alias("items"), typed.alias("t"),
    ).select("c_custkey", "key", "shown", "items", F.col("t.name").alias("name"), F.col("t.hours").alias("hours"), F.col("t.start").alias("starts"), F.col("t.end").alias("ends"), F.size("t.theory").alias("n_theory"), F.size("t.practice").alias("n_practice"))


RECORD_KEYS = f"""WITH r AS (SELECT c_custkey, {sql_normalize('c_name')} AS n, {sql_normalize(_CODE)} AS c, trim(coalesce({_SHOWN}, '')) AS s, c_name, c_mktsegment FROM customer)
SELECT c_custkey, n || '|' || CASE WHEN c = '' THEN 'plan ' || c_custkey || ' pdf' ELSE c END AS key, CASE WHEN s = '' THEN 'Sin dato' ELSE s END AS shown, 'leer;' || trim(c_name) || ';' || c_mktsegment AS items, trim(c_name) AS name,
 CASE WHEN c_custkey % 4 = 3 THEN c_custkey + 0.5 ELSE 0 END::DOUBLE AS hours, 'marzo' AS starts, '' AS ends, 3 AS n_theory, 0 AS n_practice FROM r"""


def problem_lookup(spark, d):
    """The issue at one path of a record, and whether errors stand below others."""
    return _validated(spark, d).select("id", V.problem_at("docente.codigo_documento")["kind"].alias("code_issue"), V.has_problem_under("capacitaciones").alias("rows_wrong"), V.has_problem_under("docente").alias("head_wrong"), V.has_problem_under("capacitaciones.0.fecha_fin_propuesta").alias("end_wrong"))


_UNDER = "coalesce(bool_or(severity = 'error' AND (path = '{0}' OR starts_with(path, '{0}.'))), false)"
PROBLEM_LOOKUP = f"""WITH i AS ({_sql_issues()})
SELECT o_orderkey AS id, max(i.kind) FILTER (path = 'docente.codigo_documento') AS code_issue, {_UNDER.format('capacitaciones')} AS rows_wrong, {_UNDER.format('docente')} AS head_wrong, {_UNDER.format('capacitaciones.0.fecha_fin_propuesta')} AS end_wrong
FROM orders LEFT JOIN i ON i.id = o_orderkey GROUP BY o_orderkey"""


# --- answers, agreement fields and failures ---

_ANSWERED = """'PLAN INDIVIDUAL\\n¿Qué tan cómodo/a te sientes implementando nuevas metodologías de enseñanza en el aula?\\n• ' || coalesce(text, '') || '\\n¿Qué herramientas tecnológicas utilizas regularmente en tu docencia?\\n- Aula ' || coalesce(source, '')
 || '\\n6. Actividades\\n¿Cuál es tu nivel académico actual (título registrado)?\\n: Magíster ' || doc_id || ' *\\n5. Indicadores ' || doc_id"""


def form_answers(spark, d):
    """Forms whose answers are whole documents, with bullets, printed remarks and headings that run into them."""
    rows = spread(table(spark, d, "documents")).select("doc_id", question_answers(F.expr(_ANSWERED)).alias("a"))
    of = lambda k: F.try_element_at("a", F.lit(k))
    return rows.select("doc_id", F.md5(of("comodidad_metodologias")).alias("comfort"), F.length(of("comodidad_metodologias")).alias("n_comfort"), of("herramientas_tecnologicas").alias("tools"), of("nivel_academico_actual").alias("level"), F.size("a").alias("n"))


_ENDINGS = r"(?is)\s+(?:(?:4\.?\s*)?Resumen\s+de\s+Capacitaci[oó]n(?:es)?\s+Propuestas?|(?:5\.?\s*)?Indicadores|(?:6\.?\s*)?Actividades|(?:7\.?\s*)?Impacto\s+esperado\s+en\s+el\s+docente|(?:8\.?\s*)?Visi[oó]n\s+a\s+largo\s+plazo|Formaci[oó]n\s+Docente).*$"
FORM_ANSWERS = f"""WITH a AS (SELECT doc_id, source, regexp_replace(regexp_replace({sql_compact("coalesce(text, '')")}, '^[*{C.BULLETS}\\-–—:;,.\\s]+', ''), '[*{C.BULLETS}\\-–—\\s]+$', '') AS t FROM documents),
b AS (SELECT doc_id, source, trim(regexp_replace(t, '{_ENDINGS}', '')) AS t FROM a)
SELECT doc_id, md5(t) AS comfort, length(t)::INTEGER AS n_comfort, trim('Aula ' || coalesce(source, '')) AS tools, 'Magíster ' || doc_id || ' *' AS level, 3 AS n FROM b"""

_HEAD = "CASE c_custkey % 6 WHEN 0 THEN 'VERSIÓN : 2.' || c_custkey WHEN 1 THEN 'Versión 3' WHEN 2 THEN 'conversiones: 4' ELSE '' END"
_PERSON = "CASE c_custkey % 5 WHEN 0 THEN 'con número de  cédula 01020' || lpad(cast(c_custkey as varchar(20)), 6, '0') WHEN 1 THEN 'Cédula\\n: 99' || lpad(cast(c_custkey as varchar(20)), 8, '0') WHEN 2 THEN 'teléfono de la institución 0999999999' WHEN 3 THEN 'Cédula: 12345, C.I. 0102030405' ELSE '' END"
_POST = "CASE c_custkey % 4 WHEN 0 THEN 'Cargo: Rector' WHEN 1 THEN 'CARGO : COORDINADORA de ' || c_mktsegment || '; x' WHEN 2 THEN 'se encuentra vinculado (a) como jefe de ' || c_mktsegment || ', en' ELSE 'Cargo: Profesora titular' END"


def agreement_fields(spark, d):
    """Version, a person's number and position out of agreements that name them in several ways, or something like them."""
    text = F.concat(F.lit("ACUERDO\n"), *(F.concat(F.expr(e.replace("varchar(20)", "string")), F.lit("\n")) for e in (_HEAD, _PERSON, _POST)))
    rows = spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("doc_id"), text.alias("text"), F.lit("DIGITAL").alias("method"), F.lit("a.pdf").alias("file_name"))
    return E.agreements(rows).select("doc_id", "version", "id_number", F.lower("position").alias("position"))


AGREEMENT_FIELDS = """SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN '2.' || c_custkey WHEN 1 THEN '3' ELSE '' END AS version,
 CASE c_custkey % 5 WHEN 0 THEN '01020' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 1 THEN '99' || lpad(c_custkey::VARCHAR, 8, '0') ELSE '' END AS id_number,
 CASE c_custkey % 4 WHEN 0 THEN 'docente' WHEN 1 THEN 'coordinadora de ' || lower(c_mktsegment) WHEN 2 THEN 'docente' ELSE 'profesora' END AS position FROM customer"""


def dead_letters(spark, d):
    """Documents read by two engines that fail or find too little; those that neither reads become records of an error."""
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    one = docs.select("doc_id", F.lit("DIGITAL_LINEAL").alias("engine"), F.when(n % 4 == 0, "corto").when(n % 4 == 1, None).otherwise(F.col("text")).alias("text"), F.when(n % 6 == 1, F.concat(F.lit("OSError: "), n.cast("string"))).alias("error"))
    two = docs.select("doc_id", F.lit("OCR"), F.when(n % 8 == 0, F.col("text")).otherwise(""), F.when(n % 3 == 0, "timeout"))
    good, dead = split_failures(one.union(two))
    return error_plans(dead, good).select("doc_id", "status", "detail", "confidence", F.array_join("missing", ";").alias("missing"), F.size("trainings").alias("n_trainings"), "name")


DEAD_LETTERS = """WITH r AS (SELECT doc_id, 'DIGITAL_LINEAL' AS engine, CASE doc_id % 4 WHEN 0 THEN 'corto' WHEN 1 THEN NULL ELSE text END AS t, CASE WHEN doc_id % 6 = 1 THEN 'OSError: ' || doc_id END AS e FROM documents
 UNION ALL SELECT doc_id, 'OCR', CASE WHEN doc_id % 8 = 0 THEN text ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'timeout' END FROM documents),
g AS (SELECT *, e IS NULL AND length(trim(coalesce(t, ''))) >= 80 AS good FROM r)
SELECT doc_id, 'ERROR' AS status, 'ERROR' AS detail, 0 AS confidence, arg_min(coalesce(e, 'too little text'), engine) AS missing, 0 AS n_trainings, '' AS name FROM g GROUP BY doc_id HAVING NOT bool_or(good)"""


QUERIES = {
    "text_items": (text_items, TEXT_ITEMS),
    "page_scores": (page_scores, PAGE_SCORES),
    "page_sections": (page_sections, PAGE_SECTIONS),
    "header_corner": (header_corner, HEADER_CORNER),
    "clamped_regions": (clamped_regions, CLAMPED_REGIONS),
    "activity_assignment": (activity_assignment, ACTIVITY_ASSIGNMENT),
    "line_kinds": (line_kinds, LINE_KINDS),
    "row_readings": (row_readings, ROW_READINGS),
    "record_keys": (record_keys, RECORD_KEYS),
    "problem_lookup": (problem_lookup, PROBLEM_LOOKUP),
    "form_answers": (form_answers, FORM_ANSWERS),
    "agreement_fields": (agreement_fields, AGREEMENT_FIELDS),
    "dead_letters": (dead_letters, DEAD_LETTERS),
}
