"""Layered data-quality rules: issues as data, first issue per path, layer summary, confidence and status."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import date_number, is_plan_code, loose_date_of, period_of
from ..functions.quality import FOREIGN, has_phrase
from ..functions.text import built_once, clean, js_round, let, normalize, number

# Layers of the summary and the kinds of training.
LAYERS = ("lectura", "estructura", "campos", "cruzada", "semantica", "consenso", "plantilla", "duplicados", "manual")
TRAINING_KINDS = ("aprobacion", "certificacion", "asistencia", "curso", "taller", "seminario", "congreso", "diplomado", "capacitacion")
ERROR, WARNING = "error", "warning"
ISSUE = "struct<path:string,severity:string,kind:string,category:string,layer:string>"


@dataclass(frozen=True)
class Rule:
    """One check: where ``when`` holds, the path has an issue. Rules stand in order of precedence."""

    path: str
    when: Column
    kind: str = "missing"
    category: str = "lectura"
    layer: str = "campos"
    severity: str = ERROR

    def issue(self) -> Column:
        """An array of the one issue; null where the rule does not hold."""
        parts = (self.path, self.severity, self.kind, self.category, self.layer)
        return F.when(self.when, F.array(F.struct(*(F.lit(v).alias(n) for v, n in zip(parts, ("path", "severity", "kind", "category", "layer"))))))


def warning(path: str, when: Column, category: str, layer: str) -> Rule:
    return Rule(path, when, "warning", category, layer, WARNING)


def issues(rules: list[Rule], passed: tuple[Rule, ...] = ()) -> Column:
    """The issues of a row under the rules, as an array; of those with the same path and severity only the first. passed: rules that were looked at before."""
    out, passed = [], [*passed]
    for (path, severity), run in groupby(rules, lambda r: (r.path, r.severity)):
        same = list(run)
        found = F.coalesce(*(r.issue() for r in same), F.array().cast(f"array<{ISSUE}>"))
        for earlier in (r for r in passed if (r.path, r.severity) == (path, severity)):
            found = F.when(F.coalesce(earlier.when, F.lit(False)), F.array().cast(f"array<{ISSUE}>")).otherwise(found)
        out.append(found)
        passed += same
    return F.concat(*out)


def _mixed(x: Column, longest: int) -> Column:
    """As quality.has_mixed_content, for a reading."""
    return (F.length(x["text"]) > longest) | x["key"].rlike(FOREIGN)


def reading(c: Column | str) -> Column:
    """struct(text, key): a value cleaned and normalized, which the rules look at; work it out in a projection of its own."""
    return F.struct(clean(c).alias("text"), normalize(c).alias("key"))


def listed(c: Column | str) -> Column:
    """A list's items that are not empty, joined; no item is no text."""
    return F.array_join(F.filter(F.transform(c, lambda x: clean(x)), lambda x: x != ""), " · ")


def required_text(path: str, x: Column, longest: int, layer: str = "campos") -> list[Rule]:
    return [Rule(path, x["text"] == "", layer=layer), Rule(path, _mixed(x, longest), "invalid", layer="semantica")]


def code_rules(path: str, x: Column, template: Column) -> list[Rule]:
    t = x["text"]
    old, zero = template == "ANTIGUA", F.upper(t).rlike("-00-PRO-251")
    return [
        warning(path, (t == "") & old, "plantilla", "plantilla"),
        Rule(path, (t == "") & ~old, layer="lectura"),
        Rule(path, (t != "") & zero & ~is_plan_code(t), "invalid", "contenido"),
        Rule(path, (t != "") & ~zero & ~is_plan_code(t), "invalid"),
    ]


def period_rules(path: str, x: Column, code: Column, template: Column) -> list[Rule]:
    t = x["text"]
    well = t.rlike(r"\A20[0-9]{2}-(0[1-9]|1[0-2])\z")
    of_code = period_of(code["text"])
    return [
        warning(path, (t == "") & (template == "ANTIGUA"), "plantilla", "plantilla"),
        Rule(path, (t == "") & (template != "ANTIGUA"), layer="cruzada"),
        Rule(path, (t != "") & ~well, "invalid", "contenido"),
        Rule(path, well & (of_code != "") & (of_code != t), "invalid", "contenido", "cruzada"),
    ]


def hours_rules(path: str, hours: Column) -> list[Rule]:
    h = F.coalesce(hours.cast("double"), F.lit(0.0))
    return [
        Rule(path, (h <= 0) | F.isnan(h)),
        Rule(path, h > 1000, "invalid", "contenido", "semantica"),
        warning(path, (h > 500) & (h <= 1000), "contenido", "semantica"),
    ]


def name_rules(path: str, x: Column) -> list[Rule]:
    t, key = x["text"], x["key"]
    mixed = has_phrase(key, "desde", "hasta", "aprobacion", "horas de capacitacion", "hora de capacitacion", "fecha de propuesta")
    return [Rule(path, t == ""), Rule(path, mixed | _mixed(x, 220), "invalid", layer="semantica")]


def date_rules(path: str, x: Column, d: Column, as_of_year: int) -> list[Rule]:
    """d: the date that the value names, as loose_date gives it. as_of_year stands for the present: years more than ten later are doubtful."""
    t, key = x["text"], x["key"]
    polluted = _mixed(x, 140) | has_phrase(key, "aprobacion", "horas de capacitacion", "hora de capacitacion")
    return [
        Rule(path, t == ""),
        Rule(path, (t != "") & polluted, "invalid", layer="semantica"),
        warning(path, (t != "") & d.isNull() & ~polluted, "lectura", "campos"),
        Rule(path, (d["year"] > as_of_year + 10) & ~polluted, "invalid", "contenido", "semantica"),
    ]


def date_order_rule(path: str, start: Column, end: Column) -> Rule:
    """start and end: dates as loose_date gives them."""
    a, b = date_number(start), date_number(end)
    return Rule(path, (a > 0) & (b > 0) & (b < a), "invalid", "contenido", "cruzada")


def kind_rules(path: str, x: Column) -> list[Rule]:
    t, key = x["text"], x["key"]
    known = key.rlike("|".join(TRAINING_KINDS))
    return [Rule(path, t == ""), Rule(path, _mixed(x, 60) | ~known, "invalid", layer="semantica")]


def list_rules(path: str, x: Column) -> list[Rule]:
    """x: the reading of what :func:`listed` gives."""
    return [Rule(path, x["text"] == "", layer="estructura"), Rule(path, _mixed(x, 1600), "invalid", layer="semantica")]


def training_reading(t: Column) -> Column:
    """What the rules look at in one training (struct name, hours, start, end, kind)."""
    read = F.struct(*(reading(t[k]).alias(k) for k in ("name", "start", "end", "kind")))
    dates = lambda x: F.struct(loose_date_of(x["start"]["key"]).alias("start"), loose_date_of(x["end"]["key"]).alias("end"))
    return let(read, lambda x: F.struct(*(x[k].alias(k) for k in ("name", "start", "end", "kind")), t["hours"].alias("hours"), dates(x).alias("dates")))


def training_issues(x: Column, index: Column, as_of_year: int) -> Column:
    """Issues of one training's reading; paths carry its index."""
    a, b = x["dates"]["start"], x["dates"]["end"]
    rules = [
        *name_rules("nombre", x["name"]), *hours_rules("horas", x["hours"]), *date_rules("fecha_inicio_propuesta", x["start"], a, as_of_year), *date_rules("fecha_fin_propuesta", x["end"], b, as_of_year),
        date_order_rule("fecha_fin_propuesta", a, b), *kind_rules("tipo", x["kind"]),
    ]
    return F.transform(issues(rules), lambda y: y.withField("path", F.concat(F.lit("capacitaciones."), index.cast("string"), F.lit("."), y["path"])))


# How the fields of a plan are called, and what is said of an issue by its kind.
LABELS = {
    "docente.nombre": "Nombre del docente", "docente.carrera": "Carrera", "docente.nivel_academico_actual": "Nivel académico actual", "docente.codigo_documento": "Código del documento", "docente.periodo_plan": "Periodo del plan",
    "diagnostico.capacitacion_12_meses": "Capacitación realizada en los últimos 12 meses", "diagnostico.avances_aplicados": "Avances disciplinares aplicados en clases", "diagnostico.comodidad_metodologias": "Nivel de comodidad con nuevas metodologías",
    "diagnostico.estrategias_pedagogicas": "Estrategias pedagógicas utilizadas", "diagnostico.herramientas_tecnologicas": "Herramientas tecnológicas utilizadas", "diagnostico.formacion_adicional": "Formación académica adicional necesaria",
    "diagnostico.tipo_formacion": "Tipo de formación requerida", "capacitaciones": "Capacitaciones propuestas", "detalles_plan.actividades_teoricas": "Actividades teóricas del plan", "detalles_plan.actividades_practicas": "Actividades prácticas del plan",
    "detalles_plan.impacto_esperado": "Impacto esperado del plan", "detalles_plan.vision_largo_plazo": "Visión a largo plazo del plan", "_consenso": "Consenso multimotor", "_plantilla": "Plantilla",
}
ROW_LABELS = {"nombre": "nombre", "horas": "horas", "fecha_inicio_propuesta": "fecha de inicio", "fecha_fin_propuesta": "fecha de finalización", "tipo": "tipo"}
MESSAGES = {
    "missing": "No se pudo confirmar: {}.", "invalid": "{} parece contener texto de otra sección.", "hours": "{} supera el límite razonable de 1000 horas.", "high": "{} es inusualmente alto; conviene verificarlo.", "order": "La fecha final es anterior a la fecha inicial.",
    "year": "{} contiene un año sospechoso.", "kept": "{} se conservó como texto porque no pudo normalizarse automáticamente.", "period": "El periodo no coincide con el código del documento.", "format": "El periodo debe tener el formato AAAA-MM.",
    "rows": "Los motores detectaron más filas de las que se reconstruyeron.", "none": "No se encontraron filas de capacitaciones propuestas.", "template": "La plantilla antigua no exige este campo.", "engines": "Varios motores independientes participaron en la decisión por campo.",
}


def label_of(path: Column) -> Column:
    """The name of the field at a path; rows of trainings are counted from one."""
    at, field = F.regexp_extract(path, r"\Acapacitaciones\.([0-9]+)\.", 1), F.regexp_extract(path, r"\Acapacitaciones\.[0-9]+\.(.*)\z", 1)
    name = lambda names, c: F.element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), c)
    row = F.concat(F.lit("Capacitación "), (number(at) + 1).cast("string"), F.lit(": "), name(ROW_LABELS, field))
    return F.coalesce(F.when(at != "", row), name(LABELS, path), path)


def message_of(issue: Column) -> Column:
    """What is said of an issue."""
    path, kind, category, layer = (issue[k] for k in ("path", "kind", "category", "layer"))
    ends = lambda x: path.endswith(x)
    key = (
        F.when((path == "capacitaciones") & (kind == "missing"), "none").when(layer == "consenso", F.when(path == "capacitaciones", "rows").otherwise("engines")).when(layer == "plantilla", "template")
        .when(ends("horas") & (kind == "warning"), "high").when(ends("horas") & (kind == "invalid"), "hours").when(ends("propuesta") & (layer == "cruzada"), "order").when(ends("propuesta") & (category == "contenido"), "year")
        .when(kind == "warning", "kept").when(ends("periodo_plan") & (layer == "cruzada") & (kind == "invalid"), "period").when(ends("periodo_plan") & (kind == "invalid"), "format").otherwise(kind)
    )
    said = F.element_at(F.create_map(*(F.lit(x) for item in MESSAGES.items() for x in item)), key)
    return F.replace(said, F.lit("{}"), label_of(path))


def with_messages(rows: DataFrame) -> DataFrame:
    """Adds messages: struct(path, severity, label, message) of every issue, and missing_fields, what is said of the errors."""
    told = F.transform("issues", lambda x: F.struct(x["path"].alias("path"), x["severity"].alias("severity"), label_of(x["path"]).alias("label"), message_of(x).alias("message")))
    return rows.withColumn("messages", told).withColumn("missing_fields", F.transform(F.filter("messages", lambda m: m["severity"] == ERROR), lambda m: m["message"]))


DIAGNOSIS = {
    # The seven answers and their longest plausible lengths.
    "capacitacion_12_meses": 1200,
    "avances_aplicados": 1200,
    "comodidad_metodologias": 1200,
    "estrategias_pedagogicas": 1200,
    "herramientas_tecnologicas": 1200,
    "formacion_adicional": 1200,
    "tipo_formacion": 400,
}


def validated_plans(plans: DataFrame, as_of_year: int) -> DataFrame:
    """Adds issues, confidence, status and detail to plans.

    plans: name, career, level, code, period, template (strings), diagnosis (struct of the seven
    answers), trainings (array<struct<name, hours, start, end, kind>>), expected_rows (int), theory and
    practice (array<string>), impact, vision (strings), engines (int, how many took part), status.
    Rows with status ERROR keep it and get no issue.
    """
    c = F.col
    of_lists = plans.withColumns({f"_{k}": listed(k) for k in ("theory", "practice")})
    read = of_lists.withColumns(dict(zip(("_read", "_rows"), _plan_reading())))
    out = read.withColumn("issues", F.when(c("status") == "ERROR", F.array().cast(f"array<{ISSUE}>")).otherwise(_plan_issues(as_of_year)))
    return with_status(out, F.lit(5 + len(DIAGNOSIS) + 4) + F.greatest(F.lit(1), F.size("_rows") * 5)).drop("_theory", "_practice", "_read", "_rows")


_READ = ("name", "career", "level", "code", "period", "impact", "vision", *DIAGNOSIS)


@built_once
def _plan_reading() -> tuple[Column, Column]:
    """A plan's values with what its rules ask of them (null for those of no issue), and those of its trainings.

    A bare struct would not do: Spark works out its fields anew wherever a rule reads them.
    """
    values = {**{k: F.col(f"diagnosis.{k}" if k in DIAGNOSIS else k) for k in _READ}, **{k: F.col(f"_{k}") for k in ("theory", "practice")}}
    read = F.struct(*(reading(v).alias(k) for k, v in values.items()))
    return F.when(~F.coalesce(F.col("status") == "ERROR", F.lit(False)), read), F.transform(F.coalesce("trainings", F.array()), training_reading)


@built_once
def _plan_issues(as_of_year: int) -> Column:
    """All issues of a plan out of its readings, the first of each path; those of trainings have paths of their own."""
    c = F.col
    x = {k: c(f"_read.{k}") for k in (*_READ, "theory", "practice")}
    count = F.size("_rows")
    head = [
        *required_text("docente.nombre", x["name"], 140, "estructura"),
        *required_text("docente.carrera", x["career"], 160, "estructura"),
        *required_text("docente.nivel_academico_actual", x["level"], 180),
        *code_rules("docente.codigo_documento", x["code"], c("template")),
        *period_rules("docente.periodo_plan", x["period"], x["code"], c("template")),
        *(r for field, longest in DIAGNOSIS.items() for r in required_text(f"diagnostico.{field}", x[field], longest, "estructura")),
        Rule("capacitaciones", count == 0, layer="estructura"),
    ]
    tail = [
        Rule("capacitaciones", c("expected_rows") > count, "invalid", layer="consenso"),
        *list_rules("detalles_plan.actividades_teoricas", x["theory"]),
        *list_rules("detalles_plan.actividades_practicas", x["practice"]),
        *required_text("detalles_plan.impacto_esperado", x["impact"], 1600, "estructura"),
        *required_text("detalles_plan.vision_largo_plazo", x["vision"], 1600, "estructura"),
        warning("_consenso", c("engines") >= 2, "consenso", "consenso"),
        warning("_plantilla", c("template") == "ANTIGUA", "plantilla", "plantilla"),
    ]
    of_rows = F.flatten(F.transform("_rows", lambda t, i: training_issues(t, i, as_of_year)))
    return F.concat(issues(head), of_rows, issues(tail, (*head,)))


def with_status(rows: DataFrame, total: Column) -> DataFrame:
    """Adds confidence (0 to 100), status and detail from column issues; total: how many fields count."""
    of = lambda severity: F.filter("issues", lambda x: x["severity"] == severity)
    errors, warnings = F.size(of(ERROR)), F.size(of(WARNING))
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), js_round((total - errors - warnings * 0.15) / total * 100))).cast("int")
    content = F.exists(of(ERROR), lambda x: x["category"] == "contenido")
    detail = (
        F.when((errors > 0) & content, "REVISAR_CONTENIDO").when(errors > 0, "REVISAR_LECTURA").when(F.col("template") == "ANTIGUA", "PLANTILLA_ANTIGUA").when(warnings > 0, "COMPLETO_CON_ADVERTENCIAS").otherwise("COMPLETO")
    )
    failed = F.col("status") == "ERROR"
    rows = rows.withColumn("confidence", confidence).withColumn("detail", F.when(failed, "ERROR").otherwise(detail))
    return rows.withColumn("status", F.when(failed, "ERROR").when(errors > 0, "REVISAR").otherwise("COMPLETO"))


def layer_summary(rows: DataFrame, key: str) -> DataFrame:
    """One row for each row and layer: errors, warnings, ok."""
    n = lambda layer, severity: F.size(F.filter("issues", lambda x: (x["layer"] == layer) & (x["severity"] == severity)))
    layers = F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), n(x, ERROR).alias("errors"), n(x, WARNING).alias("warnings")) for x in LAYERS)))
    return rows.select(key, layers.alias("x")).select(key, "x.layer", "x.errors", "x.warnings", (F.col("x.errors") == 0).alias("ok"))


def problem_at(path: Column | str) -> Column:
    """The issue at a path, null if there is none."""
    return F.get(F.filter("issues", lambda x: x["path"] == path), 0)


def has_problem_under(prefix: str) -> Column:
    """Whether an error stands at a path or below it."""
    return F.exists("issues", lambda x: (x["severity"] == ERROR) & ((x["path"] == prefix) | x["path"].startswith(prefix + ".")))


def evaluated_agreements(rows: DataFrame) -> DataFrame:
    """Adds issues, confidence, status to agreements.

    rows: code, signed_on, id_number, name, career, training, plan_id, position (strings), linked
    (boolean), support (array<string> of the flags that hold), percent (double).
    """
    c = F.col
    partial, full = F.array_contains("support", "parcial"), F.array_contains("support", "total")
    missing = [("acuerdo.codigo", "code"), ("acuerdo.fecha_suscripcion", "signed_on"), ("docente.cedula", "id_number"), ("docente.nombre", "name"), ("docente.carrera", "career"), ("docente.cargo", "position"), ("capacitacion.nombre", "training"), ("capacitacion.plan_id", "plan_id")]
    rules = [Rule(path, clean(c(column)) == "") for path, column in missing]
    rules += [
        Rule("capacitacion.vinculada", ~F.coalesce(c("linked"), F.lit(False)), layer="cruzada"),
        Rule("patrocinio", F.coalesce(F.size("support"), F.lit(0)) <= 0, layer="estructura"),
        Rule("patrocinio", partial & full, "invalid", "contenido", "cruzada"),
        Rule("patrocinio.porcentaje_financiado", partial & ~F.coalesce((c("percent") > 0) & (c("percent") <= 100), F.lit(False)), "invalid", "contenido"),
    ]
    out = rows.withColumn("issues", issues(rules)).withColumn("template", F.lit(""))
    out = out.withColumn("status", F.lit("")) if "status" not in rows.columns else out
    return with_status(out, F.lit(11)).drop("template")
