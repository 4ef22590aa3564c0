"""From readings of a document to one validated record: candidates, consensus, fallback.

readings: doc_id, engine, seq (order of the engines), text, file_name, region_text (text of code
regions, '' if none). A document has a few readings; everything is joined and grouped by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaners import BLANKS, answer, diagnosis, is_useful_plan, section_text, teacher_name, training_name
from ..functions.codes import code_candidates, period_of
from ..functions.quality import field_quality, signal_of_key, signal_score, text_quality
from ..functions.text import built_once, clean, compact, js_round, let, normalize, number, smart_case, text
from ..shared import by_shuffle, materialize
from . import extraction as E
from .consensus import aligned_rows, best_text, cell_vote, code_vote, engine_weight, list_union, ranked_engines, vote
from .linkage import canonical_match, match_training
from .validation import DIAGNOSIS, LABELS, evaluated_agreements, validated_plans

# The questions of the form, as patterns on folded lower-case text.
QUESTIONS = {
    "capacitacion_12_meses": r"(?:en\s+que\s+curso\s+o\s+programa\s+de\s+actualizacion\s+has\s+participado\s+en\s+los\s+ultimos\s+12\s+meses|has\s+participado\s+recientemente\s+en\s+algun\s+curso\s+o\s+programa\s+de\s+actualizacion\s+en\s+tu\s+area\s+de\s+ensenanza)",
    "avances_aplicados": r"(?:podrias\s+mencionar\s+uno\s+o\s+mas\s+avances\s+recientes\s+en\s+tu\s+campo\s+disciplinar\s+que\s+hayas\s+aplicado\s+en\s+tus\s+clases|consideras\s+que\s+tienes\s+suficientes\s+conocimientos\s+sobre\s+las\s+ultimas\s+investigaciones\s+o\s+avances\s+en\s+tu\s+disciplina)",
    "comodidad_metodologias": r"que\s+tan\s+comod[oa](?:\s*/?\s*a|\s*la)?\s+te\s+sientes\s+implementando\s+nuevas\s+metodologias\s+de\s+ensenanza\s+en\s+el\s+aula",
    "estrategias_pedagogicas": r"(?:que\s+estrategias\s+pedagogicas\s+innovadoras\s+aplicas\s+en\s+tu\s+practica\s+docente|conoces\s+y\s+aplicas\s+estrategias\s+pedagogicas\s+innovadoras)",
    "herramientas_tecnologicas": r"(?:que\s+herramientas\s+tecnologicas\s+utilizas\s+regularmente\s+en\s+tu\s+docencia|tienes\s+experiencia\s+en\s+la\s+utilizacion\s+de\s+plataformas\s+virtuales\s+o\s+tecnologia\s+educativa)",
    "formacion_adicional": r"que\s+formacion\s+academica\s+adicional\s+consideras\s+necesaria\s+para\s+fortalecer\s+tu\s+perfil\s+profesional",
    "nivel_academico_actual": r"cual\s+es\s+tu\s+nivel\s+academico\s+actual(?:\s*\(\s*titulo\s+registrado\s*\))?",
    "tipo_formacion": r"la\s+formacion\s+academica\s+que\s+propones\s+es\s+especifica\s+o\s+generica",
}
# What a text holds, in or out of words, wherever it holds the question, in each of its forms.
QUESTION_WORDS = {
    "capacitacion_12_meses": "actualizacion", "avances_aplicados": "disciplin", "comodidad_metodologias": "metodologias", "estrategias_pedagogicas": "innovadoras",
    "herramientas_tecnologicas": "tecnologi", "formacion_adicional": "fortalecer", "nivel_academico_actual": "academico", "tipo_formacion": "generica",
}
# Phrases of the form and what they add to the signal that a text is a plan; questions add up to two.
SIGNALS = {"plan individual de formacion y capacitacion": 3, "pro 251": 3, "nombre docente": 1, "tiempo de dedicacion": 1, "resumen de capacitacion": 1, "impacto esperado en el docente": 1}
LEAST_SIGNAL, SURE_SIGNAL = 3, 4
# Careers as the dimension spells them.
CAREERS = [
    "Administración", "Contabilidad", "Desarrollo de Software", "Diseño Multimedia", "Educación Básica", "Educación Inicial", "Enfermería", "Estética Integral", "Gestión del Talento Humano",
    "Marketing Digital y Comercio Electrónico", "Mecánica Automotriz", "Procesamiento de Alimentos", "Redes y Telecomunicaciones", "Seguridad Ciudadana y Orden Público", "Seguridad y Prevención de Riesgos Laborales",
]
# Weights of the sources of a code, and of its repair from a record's own code, its text, file name and regions (only the text counts up to three times).
CODE_SOURCES = {"LINEAL": 1, "POSICIONAL": 2, "REGION_CODIGO": 4, "ESQUINA_ENCABEZADO": 5, "OCR": 3}
REPAIR_WEIGHTS, REPAIR_CAPS = (2, 1, 4, 5), (1, 3, 1, 1)
TRAINING = "array<struct<name:string,hours:double,start:string,end:string,kind:string>>"
SCALARS = {"name": "name", "career": "text", "level": "text", **{k: "text" for k in DIAGNOSIS}}


@built_once
def _codes_of(column: str) -> Column:
    return code_candidates(column)


@built_once
def _quality_of(kind: str) -> Column:
    """Quality of the column value as a field of that kind."""
    return field_quality(kind, F.col("value"))


def question_answers(c: Column | str) -> Column:
    """Map question -> cleaned answer of a form's text."""
    return F.transform_values(E.answers(compact(c), QUESTIONS, "¿?*•" + BLANKS, QUESTION_WORDS), lambda _, v: answer(v))


def plan_signal(c: Column | str) -> Column:
    """How much a text looks like a plan."""
    holds = lambda key, q: key.contains(QUESTION_WORDS[q]) & key.rlike(QUESTIONS[q].replace(r"\s*", " ?").replace(r"\s+", " "))
    asked = lambda key: F.least(F.lit(2), sum((holds(key, q).cast("int") for q in QUESTIONS), F.lit(0)))
    return let(normalize(c), lambda key: signal_of_key(key, SIGNALS) + asked(key))


def header_codes(sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, confidence and period: the code that the sources agree on most. sources: key, seq, source (of CODE_SOURCES) and text.

    Each candidate of a source adds its confidence times the source's weight; the earliest wins ties.
    """
    weight = F.element_at(F.create_map(*(F.lit(x) for item in CODE_SOURCES.items() for x in item)), F.col("source"))
    found = sources.select(key, "seq", weight.alias("weight"), F.explode(_codes_of("text")).alias("c"))
    points = found.groupBy(key, "c.code").agg(F.sum(F.col("weight") * F.col("c.confidence") / 100).alias("points"), F.min("seq").alias("first"))
    best = points.groupBy(key).agg(F.max_by(F.struct("code", "points"), F.struct(F.round("points", 6), -F.col("first"))).alias("x"))
    return best.select(key, "x.code", F.least(F.lit(100), js_round(55 + F.round("x.points", 6) * 8)).cast("int").alias("confidence"), period_of("x.code").alias("period"))


def repaired_codes(records: DataFrame, key: list[str]) -> DataFrame:
    """key, repaired: the code voted by a record's own code, its text, its file name and its code regions (columns code, text, file_name, region_text)."""
    sources = F.array(*(text(c) for c in ("code", "text", "file_name", "region_text")))
    each = records.select(*key, F.posexplode(sources).alias("source_idx", "t")).select(*key, "source_idx", F.explode(_codes_of("t")).alias("c")).select(*key, "source_idx", F.col("c.code").alias("code"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("source_idx") + 1)
    return code_vote(each.withColumn("weight", of(REPAIR_WEIGHTS)).withColumn("cap", of(REPAIR_CAPS)), key).select(*key, F.col("code").alias("repaired"))


@built_once
def _parsing() -> tuple[Column, ...]:
    """What a candidate needs of its text besides the plan's columns: answers, the table's text, the signal."""
    # rows of the table's lines, for forms whose cells run over several
    table = E.section_of(F.col("_both"), r"4\.?\s*resumen", (r"5\.?\s*indicador",), (r"6\.?\s*actividad",))
    return question_answers("text").alias("answers"), table.alias("table"), plan_signal("text").alias("signal")


@built_once
def _candidate() -> tuple[Column, ...]:
    """A candidate's columns out of what was parsed."""
    of = lambda k: F.coalesce(F.try_element_at("answers", F.lit(k)), F.lit(""))
    training = lambda x: F.struct(training_name(x["name"]).alias("name"), x["hours"].cast("double").alias("hours"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    best = E.best_rows(F.col("trainings"), F.coalesce("rows", F.filter("trainings", lambda x: F.lit(False))))
    return (
        teacher_name("name").alias("name"), "canonical", F.coalesce(F.nullif(smart_case(of("nivel_academico_actual")), F.lit("")), F.col("level")).alias("level"), F.coalesce("repaired", "code").alias("code"), "period", "template",
        F.struct(*(of(k).alias(k) for k in DIAGNOSIS)).alias("diagnosis"), F.transform(best, training).cast(TRAINING).alias("trainings"), F.coalesce(F.size("rows"), F.lit(0)).alias("n_table"), "theory", "practice", "impact", "vision", "signal", "text",
    )


def candidates(readings: DataFrame) -> DataFrame:
    """One parsed record for each reading: doc_id, engine, seq, the plan's columns, n_table (rows that the table's text has), signal, useful and text.

    Texts are parsed in one flat projection, which is written; the steps after it read its columns.
    """
    key = ["doc_id", "engine", "seq"]
    parsed = materialize(E.plans(readings, "engine", "seq", "region_text", "text", "file_name", *_parsing()), "parsed")
    lines = E.exploded_lines(parsed.select(F.struct(*key).alias("k"), "table"), "k", "table")
    rows = E.blocks(lines, "k").select("k", "block", E.table_row("text").alias("row")).where("row.hours > 0 and row.name <> ''")
    rows = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "row"))).alias("x")).select("k.*", F.transform("x", lambda x: x["row"]).alias("rows"))
    careers = canonical_match(parsed.select(F.col("career").alias("name")).distinct(), CAREERS).select(F.col("name").alias("career"), "canonical")
    codes = repaired_codes(parsed.select(*key, "code", "text", "file_name", "region_text"), key)
    out = parsed.join(rows, key, "left").join(codes, key, "left").join(careers, "career", "left").select(*key, *_candidate()).withColumnRenamed("canonical", "career")
    out = out.withColumn("period", F.coalesce(F.nullif(period_of("code"), F.lit("")), F.col("period")))
    useful = is_useful_plan(F.col("name"), F.col("career"), F.array(*(F.col(f"diagnosis.{k}") for k in DIAGNOSIS)), F.col("trainings"))
    return out.withColumn("n_table", F.greatest("n_table", F.size("trainings"))).withColumn("useful", useful | (F.col("signal") >= LEAST_SIGNAL))


def merged_rows(ranked: DataFrame) -> DataFrame:
    """doc_id and trainings: the rows of all candidates aligned, each cell by vote. ranked: doc_id, engine, engine_idx and trainings."""
    each = ranked.select("doc_id", "engine", "engine_idx", engine_weight("engine").alias("weight"), F.posexplode("trainings").alias("pos", "t"))
    rows = each.select("doc_id", "engine", "engine_idx", "weight", (F.col("pos") + 1).alias("ord"), normalize("t.name").alias("key"), "t.name", "t.hours", "t.start", "t.end", "t.kind")
    placed = aligned_rows(rows)
    hours = F.when(F.col("hours") > 0, F.col("hours").cast("string")).otherwise("")
    cells = placed.select("doc_id", "slot", "engine", "engine_idx", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in {**{k: F.col(k) for k in ("name", "start", "end", "kind")}, "hours": hours}.items()))).alias("x")).select("doc_id", "slot", "engine", "engine_idx", "x.*")
    won = cell_vote(cells, ["doc_id", "slot", "field"])
    of = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    row = F.struct(training_name(of("name")).alias("name"), F.coalesce(number(of("hours"), "double"), F.lit(0.0)).alias("hours"), of("start").alias("start"), of("end").alias("end"), of("kind").alias("kind"))
    slots = won.groupBy("doc_id", "slot").agg(row.alias("row"))
    return slots.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slot", "row"))).alias("x")).select("doc_id", F.transform("x", lambda x: x["row"]).cast(TRAINING).alias("trainings"))


def _empty_plan() -> dict[str, Column]:
    """Columns of a record of which nothing is known."""
    return {**{k: F.lit("") for k in ("name", "career", "level", "code", "period", "impact", "vision")}, "trainings": F.array().cast(TRAINING), "theory": F.array().cast("array<string>"), "practice": F.array().cast("array<string>"), "diagnosis": F.struct(*(F.lit("").alias(k) for k in DIAGNOSIS))}


def error_plans(dead: DataFrame, good: DataFrame) -> DataFrame:
    """One record with status ERROR for each document that no engine could read: nothing is filled in, missing holds the failure.

    dead, good: dead letters (doc_id, engine, error) and readings with text enough, as
    sources.files.split_failures gives them. Documents with a good reading are left out; of several
    failures the one of the least engine by name, then the least, counts.
    """
    failed = dead.join(good.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("engine", F.lit("")).alias("engine"), text("error").alias("error"))).alias("x"))
    none = {"engines": F.lit(0), "engine_names": F.lit(""), "expected_rows": F.lit(0), "signal": F.lit(0), "useful": F.lit(False), "fallback": F.lit(False), "template": F.lit("DESCONOCIDA"), "confidence": F.lit(0), "status": F.lit("ERROR"), "detail": F.lit("ERROR")}
    issues = F.array().cast("array<struct<path:string,severity:string,kind:string,category:string,layer:string>>")
    missing = F.array(F.coalesce(F.nullif(F.trim("x.error"), F.lit("")), F.lit("unreadable")))
    return failed.select("doc_id", *(v.alias(k) for k, v in {**none, **_empty_plan()}.items()), issues.alias("issues"), missing.alias("missing"))


def consensus_plans(found: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One record for each document out of its candidates: every scalar by vote, rows aligned, lists united, the best free texts.

    found: as :func:`candidates` gives it; codes: as :func:`header_codes`; where it has none, code and
    period are voted like the rest. evidence maps each voted field to its value, confidence and engines.
    """
    ranked = ranked_engines(found)
    value = {"name": F.col("name"), "career": F.col("career"), "level": F.col("level"), "code": F.col("code"), "period": F.col("period"), **{k: F.col(f"diagnosis.{k}") for k in DIAGNOSIS}}
    kind = {**SCALARS, "code": "code", "period": "period"}
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(kind[f]).alias("kind"), text(v).alias("value")) for f, v in value.items()))
    each = ranked.select("doc_id", "engine", "engine_idx", F.inline(fields))
    quality = F.coalesce(*(F.when(F.col("kind") == k, _quality_of(k)) for k in sorted(set(kind.values()))))  # a field's value is rated once, by its kind
    votes = vote(each.withColumn("quality", quality), ["doc_id", "field"])
    of = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    evidence = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "confidence", "engines")))))
    scalars = votes.groupBy("doc_id").agg(*(of(f).alias(f) for f in ("name", "career", "level", "code", "period")), F.struct(*(of(f).alias(f) for f in DIAGNOSIS)).alias("diagnosis"), evidence.alias("evidence"))

    lists = ranked.select("doc_id", "engine_idx", F.explode(F.array(*(F.struct(F.lit(k).alias("list"), F.col(k).alias("items")) for k in ("theory", "practice")))).alias("x")).select("doc_id", "engine_idx", "x.list", F.posexplode("x.items").alias("pos", "value"))
    united = list_union(lists.withColumn("ord", F.struct("engine_idx", "pos")), ["doc_id", "list"])
    items = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.struct("pos", "value")))), lambda x: x["value"])
    lists = united.groupBy("doc_id").agg(items("theory").alias("theory"), items("practice").alias("practice"))

    free = ranked.select("doc_id", "engine", "engine_idx", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in ("impact", "vision")))).alias("x")).select("doc_id", "engine", "engine_idx", "x.*")
    texts = best_text(free.withColumn("quality", text_quality("value")), ["doc_id", "field"]).groupBy("doc_id").agg(of("impact").alias("impact"), of("vision").alias("vision"))

    about = ranked.groupBy("doc_id").agg(
        F.max("n_table").alias("expected_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("engine_idx", "engine"))), lambda x: x["engine"]), ",").alias("engine_names"),
        F.count_distinct("engine").cast("int").alias("engines"), F.max("useful").alias("useful"), F.max("signal").alias("signal"), F.min_by("template", F.struct(F.col("template") == "DESCONOCIDA", "engine_idx")).alias("template"),
    )
    out = about.join(scalars, "doc_id", "left").join(merged_rows(ranked), "doc_id", "left").join(lists, "doc_id", "left").join(texts, "doc_id", "left")
    out = out.withColumns({k: F.coalesce(F.col(k), v) for k, v in _empty_plan().items()})
    if codes is not None:
        out = out.join(codes.select("doc_id", F.col("code").alias("h_code"), F.col("period").alias("h_period"), F.col("confidence").alias("code_confidence")), "doc_id", "left")
        out = out.withColumns({"code": F.coalesce("h_code", "code"), "period": F.coalesce("h_period", "period")}).drop("h_code", "h_period")
    return out


def code_sources(readings: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """The sources of a document's code by its readings: their texts by engine, their code regions, and the upper right corners of first pages (doc_id and text, as geometry.header_corner gives them)."""
    engine = F.when(F.col("engine") == "DIGITAL_LINEAL", "LINEAL").when(F.col("engine") == "DIGITAL_POSICIONAL", "POSICIONAL").when(F.col("engine").contains("OCR"), "OCR")
    own = readings.select("doc_id", "seq", engine.alias("source"), "text").where("source is not null")
    out = own.union(readings.where("region_text <> ''").select("doc_id", "seq", F.lit("REGION_CODIGO"), "region_text"))
    return out if corners is None else out.union(corners.select("doc_id", F.lit(1 << 20), F.lit("ESQUINA_ENCABEZADO"), "text"))


def with_fallback(records: DataFrame) -> DataFrame:
    """Adds fallback: whether a record needs another engine. It has no code though its form has one, fewer rows than an engine saw, or two problems."""
    errors = F.size(F.filter("issues", lambda x: x["severity"] == "error"))
    return records.withColumn("fallback", ((F.col("template") == "MODERNA") & (clean("code") == "")) | (F.col("expected_rows") > F.size("trainings")) | (errors >= 2))


def evaluated_plans(records: DataFrame, as_of_year: int) -> DataFrame:
    """Records with issues, confidence, status and detail; what is neither a plan nor useful as one is NO_ES_PLAN. records: as consensus_plans gives them."""
    ready = records if "status" in records.columns else records.withColumn("status", F.lit(""))
    out = validated_plans(ready, as_of_year)
    other = (F.col("status") != "ERROR") & ~F.coalesce("useful", F.lit(False)) & (F.coalesce("signal", F.lit(0)) < SURE_SIGNAL)
    return out.withColumn("detail", F.when(other, "NO_ES_PLAN").otherwise(F.col("detail"))).withColumn("status", F.when(other, "NO_ES_PLAN").otherwise(F.col("status")))


def processed_plans(readings: DataFrame, as_of_year: int, least: int = 80, regions: DataFrame | None = None, corners: DataFrame | None = None) -> DataFrame:
    """One validated record for each document out of its readings; readings of too little text don't count. fallback: whether another engine should read the document.

    regions: as :func:`with_regions` takes them; corners: as :func:`code_sources` does.
    """
    good, found = _read(readings, least, regions)
    return _decided(found, code_sources(good, corners), as_of_year)


def _read(readings: DataFrame, least: int, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Readings of text enough, and their candidates, written: texts are parsed once for all the votes."""
    good = readings.where(F.length(F.trim(text("text"))) >= least).withColumn("region_text", text("region_text"))
    found = candidates(good)
    return good, materialize(found if regions is None else with_regions(found, regions), "candidates")


def _decided(found: DataFrame, sources: DataFrame, as_of_year: int) -> DataFrame:
    """Validated records out of candidates and the sources of their codes."""
    records = materialize(consensus_plans(found, header_codes(sources)), "consensus")
    return with_fallback(evaluated_plans(records, as_of_year))


def twice_processed_plans(readings: DataFrame, second: DataFrame, as_of_year: int, least: int = 80, regions: DataFrame | None = None, corners: DataFrame | None = None) -> DataFrame:
    """As :func:`processed_plans`, then once more for the documents that need another engine, with the second readings beside the first ones; column reread says which.

    second: readings as the first, of any documents, whose seq comes after theirs. Only those of
    documents that the first readings leave in doubt, or say nothing of, are parsed; the candidates of
    the first readings are used again as they were written. A second reading of too little text
    leaves the record as it is.
    """
    good, found = _read(readings, least, regions)
    first = materialize(_decided(found, code_sources(good, corners), as_of_year), "first-records")
    doubtful = second.join(first.where(~F.col("fallback")).select("doc_id"), "doc_id", "left_anti")
    again, more = _read(doubtful, least)
    ids = more.select("doc_id").distinct()
    both = found.join(ids, "doc_id", "left_semi").unionByName(more)
    sources = code_sources(good.join(ids, "doc_id", "left_semi").unionByName(again.select(good.columns)), corners)
    renewed = _decided(both, sources.join(ids, "doc_id", "left_semi"), as_of_year)
    kept = first.join(ids, "doc_id", "left_anti").withColumn("reread", F.lit(False))
    return kept.unionByName(renewed.withColumn("reread", F.lit(True)))


def structured_readings(readings: DataFrame, regions: DataFrame) -> DataFrame:
    """Readings of an OCR engine once more, as OCR_ESTRUCTURADO: only the texts of the page's regions (doc_id, code_text, table_text, activities_text, impact_text, vision_text), or all of the text where it has none."""
    parts = ("code_text", "table_text", "activities_text", "impact_text", "vision_text")
    joined = F.array_join(F.filter(F.array(*(text(p) for p in parts)), lambda x: F.trim(x) != ""), "\n\n")
    out = readings.join(regions.select("doc_id", joined.alias("_regions")), "doc_id", "left")
    return out.withColumns({"text": F.coalesce(F.nullif("_regions", F.lit("")), F.col("text")), "engine": F.lit("OCR_ESTRUCTURADO"), "seq": F.col("seq") + 1}).select(readings.columns)


# --- what page regions add, agreements, the simple evaluation of earlier versions ---

# Phrases of an agreement and what they add to the signal that a text is one.
AGREEMENT_SIGNALS = {"acuerdo de patrocinio institucional": 3, "pro 134": 2, "el colaborador": 1, "apoyo institucional": 1, "financiamiento total del costo del curso": 1, "compromisos": 1}


def section_activities(c: Column | str) -> Column:
    """struct(theory, practice): the items of an activity section's two lists."""
    bare = F.regexp_replace(text(c), r"(?imu)^\s*6\.?\s*Actividades\s*", " ")
    theory, practice = F.regexp_extract(bare, r"(?isu)Te[oó]ricas?\s*(.*?)(?=Pr[aá]cticas?|\z)", 1), F.regexp_extract(bare, r"(?isu)Pr[aá]cticas?\s*(.*)\z", 1)

    def items(part: Column) -> Column:
        lines = F.transform(F.split(part, r"\n|(?=\s[-=•▪◦●■□◆◇▶►])"), lambda x: F.regexp_replace(compact(x), r"\A[-=•▪◦●■□◆◇▶►*\"']+\s*", ""))
        return F.array_distinct(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"\A[0-9]+\.?\s")))

    # as a bare struct, Spark would copy each list to every place that reads it
    return let(F.struct(items(theory).alias("theory"), items(practice).alias("practice")), lambda x: x)


def with_regions(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates with what the regions of their pages say (doc_id, code_text, rows, activities_text, impact_text, vision_text; null where a region is missing).

    A code in a code region replaces that of the text; table rows replace the parsed ones if they are
    more or fuller; activities, impact and vision replace what the text has. Diagnoses lose what ran
    into them.
    """
    key = ["doc_id", "engine", "seq"]
    out = found.join(regions, "doc_id", "left")
    code = F.get(code_candidates("code_text"), 0)["code"]
    rows = E.fuller_rows(F.transform("trainings", _as_row), F.transform(F.coalesce("rows", F.array().cast(TRAINING)), _as_row))
    training = lambda x: F.struct(training_name(x["name"]).alias("name"), x["hours"].cast("double").alias("hours"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    listed = section_activities("activities_text")
    filled = lambda new, old: F.coalesce(F.nullif(new, F.lit("")), old)
    some = lambda new, old: F.when(F.size(new) > 0, new).otherwise(old)
    return out.select(
        *key, *(c for c in found.columns if c not in {*key, "code", "period", "trainings", "theory", "practice", "impact", "vision", "diagnosis"}),
        F.coalesce(code, "code").alias("code"), F.coalesce(F.nullif(period_of(code), F.lit("")), F.col("period")).alias("period"), F.transform(rows, training).cast(TRAINING).alias("trainings"),
        some(listed["theory"], F.col("theory")).alias("theory"), some(listed["practice"], F.col("practice")).alias("practice"),
        filled(section_text("impact_text", r"(?:7\.?\s*)?Impacto\s+esperado\s+en\s+el\s+docente"), F.col("impact")).alias("impact"), filled(section_text("vision_text", r"(?:8\.?\s*)?Visi[oó]n\s+a\s+largo\s+plazo(?:\s*\([^)]*\))?"), F.col("vision")).alias("vision"),
        F.struct(*(diagnosis(F.col(f"diagnosis.{k}")).alias(k) for k in DIAGNOSIS)).alias("diagnosis"),
    )


def _as_row(t: Column) -> Column:
    """A training as a row of a table."""
    return F.struct(F.lit(0).alias("ordinal"), t["name"].alias("name"), F.coalesce(t["hours"], F.lit(0.0)).alias("hours"), t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind"))


def shared_details(rows: DataFrame, key: str, order: Column, value: str = "value") -> DataFrame:
    """Rows with column details: their own detail, else all distinct details of the key, in order, joined by a bar."""
    union = list_union(rows.select(key, order.alias("ord"), F.col(value).alias("value")), [key])
    whole = union.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " | ").alias("all_details"))
    own = F.when(clean(value) != "", F.col(value)).otherwise(F.coalesce("all_details", F.lit("")))
    return rows.join(whole, key, "left").withColumn("details", own).drop("all_details")


def processed_agreements(readings: DataFrame, options: DataFrame, least: int = 80) -> DataFrame:
    """One evaluated agreement for each reading (doc_id, text, method, file_name) of text enough: its fields, the training option that it is linked to, issues, confidence and status.

    options: as linkage.match_training takes them, and plan_id.
    """
    good = readings.where(F.length(F.trim(text("text"))) >= least)
    fields = E.agreements(good, signal_score("text", AGREEMENT_SIGNALS).alias("signal"))
    support = E.support_flags(good, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("flag")).alias("support"))
    found = materialize(fields.join(by_shuffle(support), "doc_id", "left").withColumn("support", F.coalesce("support", F.array().cast("array<string>"))), "agreements")
    links = match_training(found.select(F.col("doc_id").alias("record_id"), F.col("name").alias("teacher"), "training", "period"), options)
    linked = links.join(by_shuffle(options.select("option_id", F.col("plan_id").cast("string").alias("plan_id"))), "option_id").select(F.col("record_id").alias("doc_id"), "option_id", "plan_id", js_round(F.col("score") * 100).cast("int").alias("link_confidence"))
    out = found.join(by_shuffle(linked), "doc_id", "left").withColumns({"linked": F.col("option_id").isNotNull(), "plan_id": F.coalesce("plan_id", F.lit("")), "percent": F.col("percent").cast("double")})
    return evaluated_agreements(out)


def missing_fields(plans: DataFrame) -> DataFrame:
    """Adds missing (names of empty fields), filled (0 to 100) and state: the evaluation of earlier versions, which asks for fields to be filled only.

    plans: as for validated_plans, and dedication; details count for every training.
    """
    head = {"Nombre del docente": "name", "Carrera": "career", "Tiempo de dedicación": "dedication", "Nivel académico actual": "level", "Código del documento": "code", "Periodo del plan": "period"}
    empty = [F.when(compact(c) == "", F.lit(n)) for n, c in head.items()] + [F.when(compact(F.col(f"diagnosis.{k}")) == "", F.lit(LABELS[f"diagnostico.{k}"])) for k in DIAGNOSIS]
    parts = {"nombre": lambda t: compact(t["name"]) == "", "horas": lambda t: F.coalesce(t["hours"], F.lit(0.0)) == 0, "fecha de inicio": lambda t: compact(t["start"]) == "", "fecha de finalización": lambda t: compact(t["end"]) == "", "tipo": lambda t: compact(t["kind"]) == ""}
    shared = {"actividades teóricas": F.size("theory") <= 0, "actividades prácticas": F.size("practice") <= 0, "impacto esperado": compact("impact") == "", "visión a largo plazo": compact("vision") == ""}
    named = lambda i, n: F.concat(F.lit("Capacitación "), (i + 1).cast("string"), F.lit(f": {n}"))
    row = lambda t, i: F.array_compact(F.array(*(F.when(f(t), named(i, n)) for n, f in parts.items()), *(F.when(c, named(i, n)) for n, c in shared.items())))
    none = F.size("trainings") <= 0
    of_rows = F.when(none, F.array(F.lit(LABELS["capacitaciones"]))).otherwise(F.flatten(F.transform("trainings", row)))
    total = F.lit(len(head) + len(DIAGNOSIS)) + F.greatest(F.lit(1), F.size("trainings") * (len(parts) + len(shared)))
    out = plans.withColumn("missing", F.array_distinct(F.concat(F.array_compact(F.array(*empty)), of_rows)))
    return out.withColumn("filled", js_round((total - F.size("missing")) / total * 100).cast("int")).withColumn("state", F.when(F.size("missing") > 0, "REVISAR").otherwise("COMPLETO"))
