"""Queries of the text, code and date functions over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.codes import MONTHS, canonical_plan_code, date_number, date_range, is_plan_code, loose_date, period_of, plan_code, plan_codes, spanish_date
from ..functions.quality import FOREIGN_PHRASES, has_mixed_content, markers, signal_score, text_quality, value_score
from ..functions.similarity import alias_score, rated_pairs, token_overlap
from ..functions.text import clean, compact, normalize, numeric_ocr, smart_case
from ..operators.consensus import code_vote
from ..shared import by_shuffle, spread
from .common import sql_clean, sql_compact, sql_edit_ratio, sql_normalize, sql_overlap, sql_smart_case, sql_tokens, table


def text_clean(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(clean("text")).alias("cleaned"), F.length(compact("text")).alias("n_compact"))


TEXT_CLEAN = f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned, length({sql_compact('text')})::INTEGER AS n_compact FROM documents"


def text_normalize(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(normalize("text")).alias("normalized"))


TEXT_NORMALIZE = f"SELECT doc_id, md5({sql_normalize('text')}) AS normalized FROM documents"


def smart_case_query(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat_ws(" de la ", "p_name", "p_type"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", smart_case(name).alias("title"))


_NAME = "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name || ' de la ' || p_type) ELSE p_name END"
SMART_CASE = f"SELECT p_partkey, {sql_smart_case('x')} AS title FROM (SELECT p_partkey, {_NAME} AS x FROM part)"


#: Parts into which the rows of a group are dealt, each of which meets the whole other side; ids in one list at most; pairs of a task, on average; texts that are compared at once with as many others, some.
DEALT, LISTED, PAIRS, BLOCK = 16, 1000, 4_000_000, 500


def _tasks(left, right, on):
    """How many tasks the pairs of rows need that agree in some columns. Spark would go by the bytes of what is joined, and have a few tasks give out all pairs."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("_n")).join(by_shuffle(right.groupBy(*on).agg(F.count("*").alias("_m"))), on)
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    return max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS))


def _listed(rows, ids):
    """Equal rows as one (or one for each list), their ids as a list."""
    columns = [c for c in rows.columns if c != ids]
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / LISTED).cast("int")), lambda k: F.slice("_all", k * LISTED + 1, LISTED))
    return rows.groupBy(*columns).agg(F.collect_list(F.struct(ids))[ids].alias("_all")).select(*columns, F.posexplode(lists).alias("_list", ids))


def _joined(left, right, on, part, tasks):
    """Rows of left and right that agree in some columns, dealt over the tasks: left by the hash part, each part meeting all of right."""
    every = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = left.withColumn("_part", F.pmod(part, F.lit(DEALT)))
    return dealt.repartition(tasks, *on, "_part").join(by_shuffle(every.repartition(tasks, *on, "_part")), [*on, "_part"]).drop("_part")


def _met(left, right, on, left_ids, right_ids):
    """Rows of left and right that agree in some columns, ids as lists, so that a pair of texts is compared once."""
    part = F.hash(*(c for c in left.columns if c != left_ids))
    return _joined(_listed(left, left_ids).drop("_list"), _listed(right, right_ids).drop("_list"), on, part, _tasks(left, right, on))


def _blocks(rows, on, text, ids, name):
    """Texts and ids of some rows that agree in some columns, as a list of some BLOCK: on, _block and the list."""
    rows = _listed(rows, ids)
    sizes = rows.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    block = F.pmod(F.xxhash64(text, "_list"), F.col("_blocks")).cast("int")
    return rows.join(by_shuffle(sizes), on).groupBy(*on, block.alias("_block")).agg(F.collect_list(F.struct(F.col(text).alias("text"), F.col(ids).alias("ids"))).alias(name))


def token_overlap_query(spark, d):
    p = spread(table(spark, d, "part")).select("p_brand", "p_size", F.col("p_partkey").alias("a"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    pairs = _met(p, p.withColumnsRenamed({"a": "b", "x": "y"}), ["p_brand", "p_size"], "a", "b").where("x <= y")  # the overlap is symmetric
    rated = pairs.select("a", "b", (F.col("x") == F.col("y")).alias("same"), F.round(token_overlap("x", "y", 2), 6).alias("rows_overlap"), F.round(token_overlap("x", "y", 1), 6).alias("names_overlap"))
    each = rated.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("CASE WHEN same THEN a < b ELSE a <> b END")
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rows_overlap", "names_overlap")


TOKEN_OVERLAP = f"""WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS x, p_brand, p_size FROM part),
t AS (SELECT k, p_brand, p_size, {sql_tokens('x', 2)} AS t2, {sql_tokens('x', 1)} AS t1 FROM p)
SELECT a.k AS a, b.k AS b, round({sql_overlap('a.t2', 'b.t2')}, 6) AS rows_overlap, round({sql_overlap('a.t1', 'b.t1')}, 6) AS names_overlap
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.k < b.k"""


def edit_similarity(spark, d):
    """All pairs of a supplier and a customer of its nation."""
    s = spread(table(spark, d, "supplier")).select("s_suppkey", F.col("s_nationkey").alias("nation"), normalize("s_name").alias("x"))
    c = spread(table(spark, d, "customer")).select("c_custkey", F.col("c_nationkey").alias("nation"), normalize(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("y"))
    on = ["nation"]
    pairs = _joined(_blocks(c, on, "y", "c_custkey", "a"), _blocks(s, on, "x", "s_suppkey", "b").drop("_block"), on, F.col("_block"), _tasks(c, s, on))
    rated = pairs.select("a", "b").mapInArrow(rated_pairs, "a_ids array<bigint>, b_ids array<bigint>, ratio double")
    return rated.select(F.explode("a_ids").alias("c_custkey"), "b_ids", "ratio").select(F.explode("b_ids").alias("s_suppkey"), "c_custkey", "ratio")


EDIT_SIMILARITY = f"""WITH n AS (SELECT s_suppkey, c_custkey, {sql_normalize('s_name')} AS a, {sql_normalize("c_name || ' ' || c_mktsegment")} AS b
FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, round({sql_edit_ratio('a', 'b')}, 6) AS ratio FROM n"""


ALIASES = [("cold", "frozen"), ("small", "tiny", "xs"), ("widget", "gadget")]


def alias_similarity(spark, d):
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("y"))
    return a.join(b, "a").select("a", alias_score("x", "y", ALIASES).alias("score"))


def sql_aliases(x: str, groups: list[tuple[str, ...]]) -> str:
    """A token list and the alias groups that it hits, one after the other."""
    for g in groups:
        members = "[" + ", ".join(f"'{w}'" for w in g) + "]"
        x = f"(SELECT CASE WHEN list_has_any(l, {members}) THEN list_distinct(list_concat(l, {members})) ELSE l END FROM (SELECT {x} AS l))"
    return x


ALIAS_SIMILARITY = f"""WITH t AS (SELECT p_partkey AS k, {sql_tokens('p_name', 1)} AS w FROM part),
e AS (SELECT k, {sql_aliases('w', ALIASES)} AS w FROM t)
SELECT a.k AS a, coalesce(list_sum(list_transform(list_intersect(a.w, b.w), lambda t: CASE WHEN length(t) <= 2 THEN 1 ELSE 2 END)), 0)::INTEGER AS score FROM e a JOIN e b ON b.k = a.k + 1"""


# --- codes: noisy texts made of orders by the same expressions on both sides ---

_CODE_TEXT = """CASE o_orderkey % 5
 WHEN 0 THEN 'Codigo: UGPA-RGI' || (o_orderkey % 2 + 1) || '-' || lpad(cast(o_orderkey % 150 as string), 3, '0') || '-PRO-251-' || (2000 + o_orderkey % 30) || '-' || lpad(cast(o_orderkey % 12 + 1 as string), 2, '0') || ' fin'
 WHEN 1 THEN 'UGPA_RGI1_' || (o_orderkey % 150) || '_PRO_251_' || (2000 + o_orderkey % 30) || '_' || (o_orderkey % 12 + 1)
 WHEN 2 THEN 'plan ugpa rgi2 ' || translate(cast(o_orderkey % 150 as string), '015', 'OIS') || ' pro 251 2O' || lpad(cast(o_orderkey % 30 as string), 2, '0') || ' ' || (o_orderkey % 12 + 1) || ', 2'
 WHEN 3 THEN 'sin codigo ' || o_orderkey
 ELSE 'UGPA-RGI1-00-PRO-251-2025-13' END"""
_SQL_CODE_TEXT = _CODE_TEXT.replace("as string)", "as varchar)")
_GAP = r"[\s_\-]{0,3}"
_PATTERN = rf"UGPA{_GAP}RGI{_GAP}([12]){_GAP}([0-9OQIL|SB]{{1,3}}){_GAP}PRO{_GAP}251{_GAP}(20[0-9OQIL|SB]{{2}}|2O[0-9OQIL|SB]{{2}}){_GAP}(1[0-2]|0?[1-9])(?:[^0-9]|$)".replace("|2O[0-9OQIL|SB]{2}", "")


def _digits(x: str) -> str:
    return f"regexp_replace(translate(upper({x}), 'OQIL|SB', '0011158'), '[^0-9]', '', 'g')"


_SQL_CODES = f"""SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 999 AND m BETWEEN 1 AND 12 AND regexp_full_match(y, '20[0-9]{{2}}')
 THEN 'UGPA-RGI' || g || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || '-PRO-251-' || y || '-' || CASE WHEN m < 10 THEN '0' ELSE '' END || m ELSE '' END AS code
FROM (SELECT o_orderkey, regexp_extract(t, '{_PATTERN}', 1) AS g, coalesce(try_cast({_digits(f"regexp_extract(t, '{_PATTERN}', 2)")} AS INTEGER), 0) AS n,
 {_digits(f"regexp_extract(t, '{_PATTERN}', 3)")} AS y, coalesce(try_cast({_digits(f"regexp_extract(t, '{_PATTERN}', 4)")} AS INTEGER), 0) AS m
 FROM (SELECT o_orderkey, upper({sql_clean('x')}) AS t FROM (SELECT o_orderkey, {_SQL_CODE_TEXT} AS x FROM orders)))"""


def _code_texts(spark, d):
    return spread(table(spark, d, "orders")).select("o_orderkey", F.expr(_CODE_TEXT).alias("x"))


def code_extract(spark, d):
    return _code_texts(spark, d).select("o_orderkey", plan_code("x").alias("code"))


def period_extract(spark, d):
    code = _code_texts(spark, d).select("o_orderkey", plan_code("x").alias("code"))
    return code.select("o_orderkey", period_of("code").alias("period"), is_plan_code("code").alias("valid"))


PERIOD_EXTRACT = f"SELECT o_orderkey, CASE WHEN code = '' THEN '' ELSE right(code, 7) END AS period, code <> '' AS valid FROM ({_SQL_CODES})"


def code_ocr_repair(spark, d):
    raw = F.translate(F.col("o_orderkey").cast("string"), "0158", "OISB")
    n = numeric_ocr(F.concat(F.lit("No. "), raw))
    code = canonical_plan_code(F.lit("1"), F.substring(raw, 1, 3), F.lit("2O25"), F.lit("I2"))
    return table(spark, d, "orders").select("o_orderkey", n.alias("digits"), code.alias("code"))


CODE_OCR_REPAIR = """SELECT o_orderkey, '0' || o_orderkey AS digits, CASE WHEN try_cast(substr(o_orderkey::VARCHAR, 1, 3) AS INTEGER) > 0
 THEN 'UGPA-RGI1-' || CASE WHEN try_cast(substr(o_orderkey::VARCHAR, 1, 3) AS INTEGER) < 10 THEN '0' ELSE '' END || try_cast(substr(o_orderkey::VARCHAR, 1, 3) AS INTEGER) || '-PRO-251-2025-12' ELSE '' END AS code FROM orders"""

#: Weights of the code sources (previous value, text, file name, others); hits of the text count up to three times.
SOURCE_WEIGHTS, TEXT_SOURCE, TEXT_CAP = (2, 1, 4, 5), 1, 3


def code_vote_query(spark, d):
    o = _code_texts(spark, d)
    n = F.col("o_orderkey")
    sources = o.select("o_orderkey", F.posexplode(F.array(F.lit("UGPA-RGI1-44-PRO-251-2025-12"), F.concat_ws(" ", "x", "x"), F.when(n % 3 == 0, F.col("x")).otherwise("UGPA-RGI1-44-PRO-251-2025-12"), F.when(n % 7 == 0, F.lit("UGPA-RGI2-09-PRO-251-2024-01")).otherwise(F.lit("")))).alias("source_idx", "s"))
    codes = sources.select("o_orderkey", "source_idx", F.explode(plan_codes("s")).alias("code"))
    weights = F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), F.col("source_idx") + 1)
    return code_vote(codes.withColumn("weight", weights).withColumn("cap", F.when(F.col("source_idx") == TEXT_SOURCE, TEXT_CAP).otherwise(1)), ["o_orderkey"])


CODE_VOTE = f"""WITH c AS ({_SQL_CODES}),
v AS (SELECT o_orderkey, 'UGPA-RGI1-44-PRO-251-2025-12' AS code, 2 AS points, 0 AS idx FROM c
 UNION ALL SELECT o_orderkey, code, 2, 1 FROM c WHERE code <> ''
 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN code ELSE 'UGPA-RGI1-44-PRO-251-2025-12' END, 4, 2 FROM c WHERE o_orderkey % 3 <> 0 OR code <> ''
 UNION ALL SELECT o_orderkey, 'UGPA-RGI2-09-PRO-251-2024-01', 5, 3 FROM c WHERE o_orderkey % 7 = 0),
g AS (SELECT o_orderkey, code, sum(points)::BIGINT AS points, min(idx) AS first FROM v GROUP BY ALL)
SELECT o_orderkey, code, points FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY points DESC, first, code) AS r FROM g) WHERE r = 1"""


# --- dates ---

_MONTH = "element_at(array(" + ", ".join(f"'{m}'" for m in MONTHS) + "), cast(o_orderkey % 12 as int) + 1)"
_DATE_TEXT = f"""CASE o_orderkey % 4
 WHEN 0 THEN 'Firmado en Quito, a los ' || (o_orderkey % 31 + 1) || ' dias del mes de ' || {_MONTH} || ' de ' || (2000 + o_orderkey % 40)
 WHEN 1 THEN 'El ' || (o_orderkey % 31 + 1) || ' de ' || upper({_MONTH}) || ' de ' || (2000 + o_orderkey % 40) || '.'
 WHEN 2 THEN 'Fecha: ' || (o_orderkey % 31 + 1) || '/' || (o_orderkey % 12 + 1) || '/' || (2000 + o_orderkey % 40)
 ELSE 'sin fecha' END"""
_SQL_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def spanish_date_parse(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_DATE_TEXT).alias("x"))
    return rows.select("o_orderkey", spanish_date("x")["iso"].alias("iso"), date_number(loose_date("x")).alias("loose"))


SPANISH_DATE_PARSE = """WITH p AS (SELECT o_orderkey, (o_orderkey % 31 + 1) AS d, (o_orderkey % 12 + 1) AS m, (2000 + o_orderkey % 40) AS y, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN '' ELSE coalesce(strftime(try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE), '%Y-%m-%d'), '') END AS iso,
 (CASE k WHEN 0 THEN y * 10000 + m * 100 + 1 WHEN 1 THEN y * 10000 + m * 100 + d WHEN 2 THEN y * 10000 + 101 ELSE 0 END)::INTEGER AS loose FROM p"""


def date_range_split(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("CASE l_partkey % 3 WHEN 0 THEN 'Desde ' || date_format(l_shipdate, 'yyyy-MM-dd') || '  hasta ' || date_format(l_shipdate + interval 10 days, 'yyyy-MM-dd') WHEN 1 THEN 'Desdo el ' || l_partkey || ' al ' || l_linenumber ELSE 'solo ' || l_partkey END").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", date_range("x")["start"].alias("start"), date_range("x")["end"].alias("end"))


DATE_RANGE_SPLIT = """SELECT l_orderkey, l_linenumber, l_partkey,
 CASE l_partkey % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN l_partkey::VARCHAR ELSE 'solo ' || l_partkey END AS "start",
 CASE l_partkey % 3 WHEN 0 THEN strftime(l_shipdate + INTERVAL 10 DAY, '%Y-%m-%d') WHEN 1 THEN l_linenumber::VARCHAR ELSE '' END AS "end" FROM lineitem"""


# --- scores and predicates of documents ---

PHRASES = {"the": 3, "of the": 2, "de la": 2, "und": 1, "total de horas": 4}


def signal_score_query(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", signal_score("text", PHRASES).alias("score"))


_PHRASE_SUM = " + ".join(f"CASE WHEN contains(k, ' {p} ') THEN {w} ELSE 0 END" for p, w in PHRASES.items())
SIGNAL_SCORE = f"SELECT doc_id, ({_PHRASE_SUM})::INTEGER AS score FROM (SELECT doc_id, ' ' || {sql_normalize('text')} || ' ' AS k FROM documents)"

_HEADING = r"\b[3-8] (evaluacion(es)?|evaluaciones?|resumen|indicador(es)?|actividad(es)?|impacto|vision)\b"
_FOREIGN = "(" + " OR ".join(f"contains(' ' || k || ' ', ' {p} ')" for p in FOREIGN_PHRASES) + f" OR regexp_matches(k, '{_HEADING}'))"
#: Whole texts, some with content of other parts of the form before or after them.
_NOISY = "CASE doc_id % 10 WHEN 0 THEN text || ' Total de horas 40' WHEN 1 THEN '5. Indicadores ' || text WHEN 2 THEN 'UGPA-RGI1-44 ' || text ELSE text END"


def text_quality_query(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", F.expr(_NOISY).alias("x"))
    return rows.select("doc_id", text_quality("x").alias("quality"), value_score("x").alias("value_score"))


def _sql_text_quality(noisy: str) -> str:
    return f"""SELECT doc_id, (CASE WHEN c = '' THEN -1000 ELSE least(24, ceil(length(c) / 10.0)) - CASE WHEN {_FOREIGN} THEN 80 ELSE 0 END
 - CASE WHEN regexp_matches(upper(c), '(^|[^A-Za-z0-9_])UGPA-RGI[12]([^A-Za-z0-9_]|$)') THEN 35 ELSE 0 END - CASE WHEN contains(x, chr(65533)) THEN 20 ELSE 0 END END)::INTEGER AS quality,
 least(20, ceil(length(c) / 8.0))::INTEGER AS value_score
FROM (SELECT doc_id, x, {sql_clean('x')} AS c, {sql_normalize('x')} AS k FROM (SELECT doc_id, {noisy} AS x FROM documents))"""


def mixed_content(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", F.expr(_NOISY).alias("x"))
    return rows.select("doc_id", has_mixed_content("x").alias("mixed"))


def _sql_mixed_content(noisy: str) -> str:
    return f"SELECT doc_id, c <> '' AND (length(c) > 700 OR {_FOREIGN}) AS mixed FROM (SELECT doc_id, {sql_clean('x')} AS c, {sql_normalize('x')} AS k FROM (SELECT doc_id, {noisy} AS x FROM documents))"


MARKERS = ("the", "tion", "de la", "und ", "que", "er")


def assess_text(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", markers("text", MARKERS).alias("hits"), ((F.length(clean("text")) >= 900) & (markers("text", MARKERS) >= 3)).alias("good"))


_HITS = " + ".join(f"CASE WHEN contains(f, '{m}') THEN 1 ELSE 0 END" for m in MARKERS)
ASSESS_TEXT = f"SELECT doc_id, h::INTEGER AS hits, n >= 900 AND h >= 3 AS good FROM (SELECT doc_id, length({sql_clean('text')}) AS n, ({_HITS}) AS h FROM (SELECT doc_id, text, lower(strip_accents(text)) AS f FROM documents))"


QUERIES = {
    "text_clean": (text_clean, TEXT_CLEAN),
    "text_normalize": (text_normalize, TEXT_NORMALIZE),
    "smart_case": (smart_case_query, SMART_CASE),
    "token_overlap": (token_overlap_query, TOKEN_OVERLAP),
    "edit_similarity": (edit_similarity, EDIT_SIMILARITY),
    "alias_similarity": (alias_similarity, ALIAS_SIMILARITY),
    "code_extract": (code_extract, _SQL_CODES),
    "period_extract": (period_extract, PERIOD_EXTRACT),
    "code_ocr_repair": (code_ocr_repair, CODE_OCR_REPAIR),
    "code_vote": (code_vote_query, CODE_VOTE),
    "spanish_date_parse": (spanish_date_parse, SPANISH_DATE_PARSE),
    "date_range_split": (date_range_split, DATE_RANGE_SPLIT),
    "signal_score": (signal_score_query, SIGNAL_SCORE),
    "text_quality": (text_quality_query, _sql_text_quality(_NOISY)),
    "mixed_content": (mixed_content, _sql_mixed_content(_NOISY)),
    "assess_text": (assess_text, ASSESS_TEXT),
}
