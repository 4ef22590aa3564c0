"""Fields, sections, tables and answers out of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import agreement_code, month_number, period_of, plan_code, spanish_date
from ..functions.text import EDGE_AFTER, EDGE_BEFORE, SPACE, built_once, clean, compact, fold_accents, let, lines, normalize, number, smart_case, text

# The kinds of training in the order in which they are looked for.
KIND_WORDS = ("APROBACIÓN", "CERTIFICACIÓN", "ASISTENCIA", "CURSO", "TALLER", "SEMINARIO", "CONGRESO", "DIPLOMADO", "CAPACITACIÓN")
#: The seven support options of an agreement: flag and the phrase (normalized) that names it.
SUPPORT_OPTIONS = {
    "permiso": "permiso",
    "horario": "flexibilidad de horario",
    "total": "financiamiento total",
    "parcial": "financiamiento parcial",
    "viaticos": "viaticos",
    "materiales": "materiales",
    "otro": "otro",
}


def exploded_lines(docs: DataFrame, key: str, c: str = "text") -> DataFrame:
    """One row for each line of a text that is not empty: key, pos, line."""
    return docs.select(key, F.posexplode(lines(c)).alias("pos", "line"))


def with_folded(c: Column | str) -> Column:
    """struct(t, f): a text and its folded form, which has the same characters, but for marks that stand alone; those are taken out of both."""
    return let(F.regexp_replace(text(c), r"[\u0300-\u036f]", ""), lambda t: F.struct(t.alias("t"), F.lower(fold_accents(t)).alias("f")))


def section(c: Column | str, start: str, ends: tuple[str, ...], otherwise: tuple[str, ...] = ()) -> Column:
    """Text from after the start label to the nearest end label (Java patterns, accents and case aside), or, without one, the nearest of the others; to the end if none follows."""
    return section_of(with_folded(c), start, ends, otherwise)


def section_of(both: Column, start: str, ends: tuple[str, ...], otherwise: tuple[str, ...] = ()) -> Column:
    """As :func:`section`, of what :func:`with_folded` gives."""

    def cut(x: Column) -> Column:
        t, folded, more = x["t"], x["f"], F.lit(1 << 30)
        rest = lambda after: let(F.struct(F.substring(t, after, more).alias("t"), F.substring(folded, after, more).alias("f")), ended)
        return let(F.regexp_instr(folded, F.lit(start)), lambda begin: F.when(begin == 0, "").otherwise(let(begin + F.length(F.regexp_extract(folded, start, 0)), rest)))

    def ended(rest: Column) -> Column:
        def upto(labels: tuple[str, ...], other: Column) -> Column:
            at = F.filter(F.array(*(F.regexp_instr(rest["f"], F.lit(e)) for e in labels)), lambda place: place > 0)
            return let(at, lambda stops: F.when(F.size(stops) > 0, F.trim(F.substring(rest["t"], F.lit(1), F.array_min(stops) - 1))).otherwise(other)) if labels else other

        return upto(ends, upto(otherwise, F.trim(rest["t"])))

    return let(both, cut)


def table_section(c: Column | str, start: str, preferred: str, other: str) -> Column:
    """As :func:`section`, but the preferred end label counts wherever it follows, the other one only without it."""
    return section(c, start, (preferred,), (other,))


def read_lines(c: Column | str) -> Column:
    """The lines of a text that are not empty, with their keys: array<struct(line, key)>."""
    return F.transform(lines(c), lambda x: F.struct(x.alias("line"), normalize(x).alias("key")))


def label_value(c: Column | str, label: str, stops: tuple[str, ...] = ()) -> Column:
    """What follows a label: the rest of its line, else the next line that is no other label; labels are normalized prefixes."""
    return label_value_of(read_lines(c), label, stops)


def label_value_of(rows: Column, label: str, stops: tuple[str, ...] = ()) -> Column:
    """As :func:`label_value`, of what :func:`read_lines` gives. Each step is worked out once a text, also where Spark does not look for what repeats."""
    place = lambda rows: F.array_position(F.transform(rows, lambda x: F.startswith(x["key"], F.lit(label))), True).cast("int")
    inline = lambda own: F.trim(F.regexp_replace(F.when(own.contains(":"), F.regexp_extract(own, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(F.array_join(F.slice(F.split(own, r"\s+"), F.lit(len(label.split()) + 1), F.lit(1000)), " ")), r"\A[\-–—.]+", ""))
    stopped = lambda x: F.exists(F.array(*map(F.lit, stops)).cast("array<string>"), lambda s: F.startswith(x["key"], s))
    following = lambda rows, at: F.coalesce(F.get(F.filter(F.slice(rows, at + 1, F.lit(4)), lambda x: ~stopped(x)), 0)["line"], F.lit(""))
    valued = lambda rows, at: let(let(F.get(rows, at - 1)["line"], inline), lambda own: F.when(own != "", own).otherwise(following(rows, at)))
    return let(rows, lambda rows: let(place(rows), lambda at: F.when(at == 0, "").otherwise(valued(rows, at))))


def label_values(docs: DataFrame, key: str, labels: dict[str, str], stops: tuple[str, ...] = (), reach: int = 4, whole: tuple[str, ...] = (), c: str = "text") -> DataFrame:
    """key, label, value: what stands behind each label of a document or below it, by look-ahead frames over its lines.

    labels: name -> normalized prefix of a line. A label's own line counts first: what follows its
    colon, else its words beyond the label, unless that is a label again. Otherwise the next line, up
    to a stop (a line that begins with one of the labels or stops, or with a number and a dot), and
    for labels in whole all lines up to it, reach lines at most. The first line of a label with a
    value counts; labels without a value have no row. Lines are those that are not empty.
    """
    rows = exploded_lines(docs, key, c).withColumn("folded", normalize("line"))
    starts = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)).cast("array<string>"), lambda p: F.col("folded").startswith(p))
    rows = rows.withColumn("stop", starts((*labels.values(), *stops)) | F.col("line").rlike(r"\A[0-9]+[.)]\s"))
    ahead = W.partitionBy(key).orderBy("pos").rowsBetween(1, reach)
    rows = rows.withColumn("next", F.collect_list(F.struct("line", "stop")).over(ahead))
    each = rows.withColumn("label", F.explode(F.array_compact(F.array(*(F.when(F.col("folded").startswith(p), F.struct(F.lit(n).alias("name"), F.lit(len(p.split())).alias("words"))) for n, p in labels.items())))))
    after = F.trim(F.regexp_extract("line", r"\A[^:\-–—]*[:\-–—]\s*(.*)\z", 1))
    beyond = F.array_join(F.slice(F.split("line", r"\s+"), F.col("label.words") + 1, F.lit(1 << 20)), " ")
    own = F.when(after != "", after).otherwise(F.trim(beyond))
    own = F.when(normalize(own).isin(*labels.values()), "").otherwise(own)
    until = F.aggregate("next", F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("lines")), lambda s, x: F.struct((s["over"] | x["stop"]).alias("over"), F.when(s["over"] | x["stop"], s["lines"]).otherwise(F.array_append(s["lines"], x["line"])).alias("lines")))["lines"]
    taken = F.when(F.col("label.name").isin(*whole), until).otherwise(F.slice(until, 1, 1)) if whole else F.slice(until, 1, 1)
    value = F.when(own != "", compact(own)).otherwise(compact(F.array_join(taken, " ")))
    found = each.select(key, F.col("label.name").alias("label"), "pos", value.alias("value")).where("value <> ''")
    return found.groupBy(key, "label").agg(F.min_by("value", "pos").alias("value"))


def answers(c: Column | str, questions: dict[str, str], before: str = "", words: dict[str, str] | None = None) -> Column:
    """Map question -> text between its marker and the next marker.

    questions: name -> Java pattern on folded lower-case text, without look-around; before: characters, none of which
    begins a question, that belong to a marker if they stand before it; words: name -> what a text
    holds wherever it holds the question, which is sooner looked for than a pattern.
    """

    def found(x: Column) -> Column:
        def mark(q: str, p: str) -> Column:
            """A question's marker, null if the text lacks it, as most do."""
            asked = x["f"].rlike(p)
            if words is not None:
                asked = x["f"].contains(words[q]) & asked
            return F.when(asked, let(F.regexp_extract(x["f"], p, 0), lambda match: placed(q, match)))

        def placed(q: str, match: Column) -> Column:
            # a pattern's first match is also where its words stand first; regexp_instr would count some characters twice
            at = F.instr(x["f"], match)
            if not before:
                return F.struct(at.alias("at"), F.length(match).alias("size"), F.lit(q).alias("name"))
            ahead = lambda at: F.length(F.rtrim(F.substring(x["f"], F.lit(1), at - 1), F.lit(before))) + 1
            return let(F.struct(at.alias("at"), ahead(at).alias("ahead")), lambda y: F.struct(y["ahead"].alias("at"), (y["at"] - y["ahead"] + F.length(match)).alias("size"), F.lit(q).alias("name")))

        return let(F.array_sort(F.array_compact(F.array(*(mark(q, p) for q, p in questions.items())))), lambda marks: answered(x["t"], marks))

    def answered(t: Column, marks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(marks, i + 1)["at"], F.length(t) + 1)
        cut = lambda m, i: F.substring(t, m["at"] + m["size"], end(i) - m["at"] - m["size"])
        return F.map_from_entries(F.transform(marks, lambda m, i: F.struct(m["name"], compact(F.regexp_replace(cut(m, i), r"\A[\s?:.\-]+", "")).alias("value"))))

    return let(text(c), lambda t: let(F.struct(t.alias("t"), F.lower(fold_accents(t)).alias("f")), found))


def find_kind(c: Column | str) -> Column:
    """The first kind of the list that a text holds, wherever it stands; '' if none."""

    def first(folded: Column) -> Column:
        out = F.lit("")
        for word in reversed(KIND_WORDS):
            plain = word.replace("Ó", "O")
            out = F.when(folded.contains(plain) & folded.rlike(EDGE_BEFORE + plain + EDGE_AFTER), word).otherwise(out)
        return out

    return let(F.upper(fold_accents(c)), first)


def blocks(rows: DataFrame, key: str, pos: str = "pos", line: str = "line", largest: int = 30) -> DataFrame:
    """Lines joined to blocks that begin at an ordinal from 1 to 30: key, block (1-based), ordinal, text. Lines before the first are left out."""
    ordinal = number(F.regexp_extract(F.col(line), r"\A([0-9]{1,2})(?:[.)\s]|\z)", 1))
    starts = F.coalesce(ordinal.between(1, largest), F.lit(False))
    numbered = rows.withColumn("block", F.sum(starts.cast("int")).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))).where("block > 0")
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("l"), F.when(starts, ordinal).alias("o"))))
    return numbered.groupBy(key, "block").agg(parts.alias("x")).select(key, "block", F.get("x", 0)["o"].alias("ordinal"), F.array_join(F.transform("x", lambda e: e["l"]), " ").alias("text"))


def table_row(c: Column | str) -> Column:
    """struct(ordinal, name, hours, start, end, kind) of one table row as text: the kind and the date range are taken off, the last number before them is the hours, the rest is the name."""
    # the word's edge is looked at behind the word, not at every character
    since = "desde(?<![A-Za-z0-9_]desde)"
    pattern = r"(?iu)" + since + r"\s+(.*?)\s+(?:hasta|al)\s+(.*?)(?=\s+(?:" + "|".join(KIND_WORDS) + r")(?![A-Za-z0-9_])|\z)"
    tail = r"\s*([0-9]{1,4})(?:\s*(?:h|hs|horas?))?\s*\z"

    def cells(t: Column) -> Column:
        before = F.trim(F.regexp_replace(t, rf"(?isu){since}\s.*\z", ""))
        return F.struct(number(F.regexp_extract(before, r"\A([0-9]{1,2})[.)]?\s", 1)).alias("ordinal"), F.trim(F.regexp_replace(before, r"\A[0-9]{1,2}[.)]?\s+", "")).alias("body"), F.regexp_extract(t, pattern, 1).alias("start"), F.regexp_extract(t, pattern, 2).alias("end"), find_kind(t).alias("kind"))

    def row(x: Column) -> Column:
        hours = number(F.regexp_extract(x["body"], tail, 1))
        good = F.coalesce(hours.between(1, 1000), F.lit(False))
        name = F.trim(F.when(good, F.regexp_replace(x["body"], tail, "")).otherwise(x["body"]))
        return F.struct(F.coalesce(x["ordinal"], F.lit(0)).alias("ordinal"), name.alias("name"), F.when(good, hours).otherwise(0).alias("hours"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))

    return let(let(compact(c), cells), row)


def inline_rows(c: Column | str) -> Column:
    """Table rows that stand on one line: array of :func:`table_row`, cut before each ordinal that a capital letter follows."""
    parts = F.filter(F.split(compact(c), r"\s+(?=[0-9]{1,2}[.)]?\s+(?!(?:Desde|DESDE)\s)[A-ZÁÉÍÓÚÑ][^0-9]*\s[0-9]{1,4}\s)"), lambda x: x != "")
    return F.transform(parts, table_row)


def filled_cells(row: Column) -> Column:
    """How many of the five cells of a table row are filled."""
    return (clean(row["name"]) != "").cast("int") + (F.coalesce(row["hours"], F.lit(0)) > 0).cast("int") + sum((clean(row[f]) != "").cast("int") for f in ("start", "end", "kind"))


def best_rows(a: Column, b: Column) -> Column:
    """Of two readings of a table the one with more filled cells (ten for each row besides), the first on ties; renumbered."""
    score = lambda rows: F.aggregate(rows, F.lit(0), lambda s, r: s + filled_cells(r) + 10)
    return F.transform(F.when(score(b) > score(a), b).otherwise(a), lambda r, i: r.withField("ordinal", i + 1))


def fuller_rows(a: Column, b: Column) -> Column:
    """The rows of b where they are more, or hold more filled cells, than those of a; else those of a. Renumbered."""
    filled = lambda rows: F.aggregate(rows, F.lit(0), lambda s, r: s + filled_cells(r))
    better = (F.size(b) > 0) & ((F.size(b) > F.size(a)) | (filled(b) > filled(a)))
    return F.transform(F.when(better, b).otherwise(a), lambda r, i: r.withField("ordinal", i + 1))


def activities(c: Column | str) -> Column:
    """Items of an activity list: lines without bullets and headings; a single line splits at semicolons."""
    found = lines(c)
    items = F.when(F.size(found) == 1, F.split(F.get(found, 0), ";")).otherwise(found)
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\A[\s•·*\-–o]*(?:[0-9]{1,2}[.)]\s*)?", "")))
    return F.filter(bare, lambda x: (x != "") & ~normalize(x).rlike(r"\A(actividades?)( (teoricas?|practicas?))?\z"))


def support_flags(docs: DataFrame, key: str, c: str = "text") -> DataFrame:
    """key, flag: options that are marked on the first line that names them or on the next two, up to the next option."""
    named = F.lit(None).cast("string")
    for flag, phrase in reversed(SUPPORT_OPTIONS.items()):
        named = F.when(F.contains(normalize("line"), F.lit(phrase)), flag).otherwise(named)
    rows = exploded_lines(docs, key, c).withColumn("flag", named)
    stop = F.col("flag").isNotNull() | F.contains(normalize("line"), F.lit("compromisos"))
    w = W.partitionBy(key).orderBy("pos")
    ahead = lambda k: (F.lead("line", k).over(w), F.lead(stop, k, True).over(w))
    (one, stop1), (two, stop2) = ahead(1), ahead(2)
    segment = F.concat_ws(" ", "line", F.when(~stop1, one), F.when(~stop1 & ~stop2, two))
    first = F.row_number().over(W.partitionBy(key, "flag").orderBy("pos"))
    found = rows.withColumn("segment", segment).where("flag is not null").withColumn("first", first).where("first = 1")
    return found.where(marked("segment")).select(key, "flag")


def marked(c: Column | str) -> Column:
    """Whether a text holds a mark that stands alone: x, a check or a full box, sí."""
    return text(c).rlike(r"(?iu)(?:\A|[\s(\[:])(?:x|✓|✔|☑|☒|■|s[ií])(?:\z|[\s)\].,;])")


# The title of a plan's cover, which is modern unless a colon follows it (legacy forms go on with the teacher's name); how far apart its two parts and how far down it may stand; the label of a code.
TITLE = r"(?iu)PLAN\s+INDIVIDUAL[\s\S]{0,180}?CAPACITACI[ÓO]N\s+DOCENTE"
COVER = 2400
CODE_LABEL = r"(?iu)(?<![A-Za-z0-9_])c[oó]digo\s*:"


def template_of(c: Column | str, code: Column) -> Column:
    """MODERNA with a code (one found in the text or in the header's corner), the word for it anywhere, or the modern title on the cover; ANTIGUA with the legacy title there; else DESCONOCIDA."""

    def decided(t: Column) -> Column:
        cover = F.substring(t, 1, COVER)
        labelled = F.concat(F.lit(" "), normalize(t), F.lit(" ")).contains(" codigo ") | t.rlike(CODE_LABEL)
        return F.when((code != "") | labelled | cover.rlike(TITLE + r"(?!\s*:)"), "MODERNA").when(cover.rlike(TITLE + r"\s*:"), "ANTIGUA").otherwise("DESCONOCIDA")

    return let(clean(c), decided)


def agreement_state(c: Column | str, method: Column) -> Column:
    """FIRMADO with a sign of a signature, REVISAR for OCR without one, else PENDIENTE_FIRMA."""
    key = normalize(c)
    signed = F.lit(False)
    for phrase in ("firmado electronicamente", "firmado digitalmente", "firma electronica", "validar unicamente con", "firmaec"):
        signed = signed | F.contains(key, F.lit(phrase))
    return F.when(signed, "FIRMADO").when(method.isin("OCR", "MIXTO"), "REVISAR").otherwise("PENDIENTE_FIRMA")


# The clauses of an agreement that name what its labels may leave out.
CLAUSES = {
    "name": r"(?iu)(?:se[nñ]or\(a\)|se[nñ]or|colaborador(?:a)?)\s+(.+?),\s+con\s+n[uú]mero\s+de\s+c[eé]dula",
    "training": r"(?iu)participaci[oó]n\s+de\s+(?:el|la)\s+colaborador(?:a)?\s+en\s+la\s+capacitaci[oó]n\s+(.+?),\s+con\s+el\s+objetivo",
    "position": r"(?iu)se\s+encuentra\s+vinculad[oa]\s*(?:\(a\)\s*)?como\s+([^.,;]+?)\s+en\s+el\s+\S",
}


# How an agreement gives its version, a person's number (with its name before it, and nothing else) and one of the positions that it knows.
VERSION = r"(?iu)versi[oó]n\s*[:：]?\s*([0-9]+(?:\.[0-9]+)*)"
ID_NUMBER = r"(?iu)c[eé]dula\s*[:：]?\s*([0-9]{10,13})"
POSITION = r"(?iu)cargo\s*[:：]\s*(docente|profesora?|coordinadora?[^|,;]*)"


def clause(line: Column | str, kind: str) -> Column:
    """What a clause of an agreement (its text on one line) names, in title case; '' without the clause."""
    return smart_case(F.regexp_extract(line, CLAUSES[kind], 1))


def cover_value(rows: Column, label: str, stops: tuple[str, ...]) -> Column:
    """A label's value on the cover (:func:`read_lines`); a title of the form is none."""
    value = smart_case(label_value_of(rows, label, stops))
    return let(value, lambda v: F.when(normalize(v).rlike("acuerdo|institucional"), "").otherwise(v))


def either(*values: Column) -> Column:
    """The first value that is not empty, later ones not looked at; '' if all are."""
    out = F.lit("")
    for value in reversed(values):
        out = _or_else(value, out)
    return out


def _or_else(value: Column, other: Column) -> Column:
    return let(value, lambda v: F.when(v != "", v).otherwise(other))


def agreements(readings: DataFrame, *more: Column) -> DataFrame:
    """Agreement fields of readings (doc_id, text, method, file_name); more: columns to carry along."""
    read = readings.withColumns({"_line": compact("text"), "_lines": read_lines("text"), "_date": spanish_date("text"), "_code": either(agreement_code("text"), agreement_code("file_name"))})
    t, line, value = F.col("text"), F.col("_line"), lambda *labels: smart_case(label_value_of(F.col("_lines"), *labels))
    cover = lambda *labels: cover_value(F.col("_lines"), *labels)
    percent = number(F.regexp_replace(F.regexp_extract(t, r"([0-9]{1,3}(?:[.,][0-9]{1,2})?)\s*%", 1), ",", "."), "decimal(5,2)")
    return read.select(
        "doc_id", F.col("_code").alias("code"), period_of("_code").alias("period"), F.col("_date.iso").alias("signed_on"), F.col("_date.original").alias("signed_text"),
        F.regexp_extract(line, VERSION, 1).alias("version"), F.regexp_extract(line, ID_NUMBER, 1).alias("id_number"),
        either(value("nombre del docente", ("cedula", "carrera", "cargo")), cover("docente", ("carrera", "capacitacion")), clause(line, "name")).alias("name"),
        either(value("carrera", ("cedula", "nombre", "cargo", "capacitacion", "elaborado", "firma"))).alias("career"),
        either(clause(line, "position"), smart_case(F.regexp_extract(line, POSITION, 1)), F.lit("Docente")).alias("position"),
        F.regexp_replace(either(label_value_of(F.col("_lines"), "nombre de la capacitacion", ("fecha", "cedula")), cover("capacitacion", ("elaborado", "firma", "unidad")), clause(line, "training")), r"\.+\z", "").alias("training"),
        agreement_state(t, F.col("method")).alias("state"), percent.alias("percent"), *more,
    )


@built_once
def plan_columns() -> tuple[Column, ...]:
    """What :func:`plans` reads out of the columns text and file_name, and _own, _both and _lines: the text's code, the text folded, its lines."""
    own, part, value = F.col("_own"), lambda *labels: section_of(F.col("_both"), *labels), lambda *labels: label_value_of(F.col("_lines"), *labels)
    return (
        F.when(own != "", own).otherwise(plan_code("file_name")).alias("code"), template_of("text", own).alias("template"),
        smart_case(value("nombre del docente", ("carrera", "tiempo", "nivel"))).alias("name"),
        smart_case(value("carrera", ("tiempo", "nivel", "nombre"))).alias("career"),
        value("nivel academico actual", ("nombre", "carrera")).alias("level"),
        F.filter(inline_rows(part(r"4\.?\s*resumen", (r"5\.?\s*indicador", r"6\.?\s*actividad"))), lambda r: r["ordinal"] > 0).alias("trainings"),
        activities(part(r"actividades\s+teoricas", (r"actividades\s+practicas", r"7\.?\s*impacto"))).alias("theory"),
        activities(part(r"actividades\s+practicas", (r"7\.?\s*impacto",))).alias("practice"),
        compact(part(r"7\.?\s*impacto[^\n]*", (r"8\.?\s*vision",))).alias("impact"),
        compact(part(r"8\.?\s*vision[^\n]*", ())).alias("vision"),
    )


def plans(readings: DataFrame, *more: str | Column) -> DataFrame:
    """Plan fields of readings (doc_id, text, file_name): names, code, period, template and training rows; more: columns to carry along, which may read the folded text (_both) and the lines (_lines), too."""
    read = readings.withColumns({"_own": plan_code("text"), "_both": with_folded("text"), "_lines": read_lines("text")})
    return read.select("doc_id", *more, *plan_columns()).withColumn("period", period_of("code"))
