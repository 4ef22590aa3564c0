"""Document codes, periods and Spanish dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, fold_accents, let, normalize, number, numeric_ocr, text

# The parts of the two code families and the month names.
PLAN_UNIT, PLAN_PROCESS = "UGPA", "251"
AGREEMENT_UNITS, AGREEMENT_PROCESS = ("UGPA", "CGC"), "134"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MONTH_ALIASES = {"setiembre": 9}
YEARS = (2000, 2100)

# The shapes of the two code families.
_GAP = r"[\s_\-]{0,3}"
_DIGITS = "[0-9OQIL|SB]"
PLAN_CODE = rf"UGPA{_GAP}RGI{_GAP}([12]){_GAP}({_DIGITS}{{1,3}}){_GAP}PRO{_GAP}251{_GAP}(20{_DIGITS}{{2}}){_GAP}(1[0-2]|0?[1-9])(?:[^0-9]|$)"
AGREEMENT_CODE = rf"(UGPA|CGC){_GAP}RGI{_GAP}2{_GAP}([0-9]{{1,3}}){_GAP}PRO{_GAP}134{_GAP}(20[0-9]{{2}}){_GAP}(1[0-2]|0?[1-9])(?:[^0-9]|$)"


def _number(c: Column) -> Column:
    return F.coalesce(number(numeric_ocr(c)), F.lit(0))


def canonical_plan_code(group: Column, sequence: Column, year: Column, month: Column) -> Column:
    """The code in its one spelling (sequence of two digits or more, month of two); '' if a part is out of range."""
    two = lambda v: F.lpad(v.cast("string"), F.greatest(F.length(v.cast("string")), F.lit(2)), F.lit("0"))

    def spelled(p: Column) -> Column:
        good = p["g"].isin("1", "2") & p["n"].between(1, 999) & p["y"].rlike(r"\A20[0-9]{2}\z") & p["m"].between(1, 12)
        return F.when(good, F.concat(F.lit("UGPA-RGI"), p["g"], F.lit("-"), two(p["n"]), F.lit("-PRO-251-"), p["y"], F.lit("-"), two(p["m"]))).otherwise("")

    return let(F.struct(group.alias("g"), _number(sequence).alias("n"), numeric_ocr(year).alias("y"), _number(month).alias("m")), spelled)


def plan_code(c: Column | str) -> Column:
    """First plan code of a text, canonical; '' if there is none."""
    # parts are read from the match, not each from all of the text
    return let(F.regexp_extract(F.upper(clean(c)), PLAN_CODE, 0), lambda match: canonical_plan_code(*(F.regexp_extract(match, PLAN_CODE, k) for k in (1, 2, 3, 4))))


def plan_codes(c: Column | str) -> Column:
    """All plan codes of a text, canonical, repeats kept: each is a vote."""
    groups = lambda t, k: F.regexp_extract_all(t, F.lit(PLAN_CODE), k)

    def spelled(t: Column) -> Column:
        found = F.arrays_zip(groups(t, 1).alias("g"), groups(t, 2).alias("n"), groups(t, 3).alias("y"), groups(t, 4).alias("m"))
        return F.filter(F.transform(found, lambda x: canonical_plan_code(x["g"], x["n"], x["y"], x["m"])), lambda x: x != "")

    return let(F.upper(clean(c)), lambda t: F.when(t.contains("UGPA"), spelled(t)).otherwise(F.array().cast("array<string>")))


# The parts of a plan code as OCR may read them, and how sure a code is by how it was found.
_READ = {"unit": "U[G6]P[A4]", "family": "R[G6][I1L|]", "process": "PR[OQ0]", "number": "25[I1L|]"}
DIRECT, JOINED, SCATTERED = 98, 94, 88


def code_candidates(c: Column | str) -> Column:
    """Plan codes of a text that OCR may have read badly: array of struct(code, confidence), the surest first.

    Letters of the fixed parts may be digits and the other way round. A code whose parts follow each
    other, with blanks or dashes at most, is the surest; then one that appears once all else than
    letters and digits is taken out; then one with other text between its parts.
    """
    small = r"\s*[- ]?\s*"
    tail = rf"({_DIGITS}{{1,2}})"
    direct = rf"{_READ['unit']}{small}{_READ['family']}\s*([12]){small}({_DIGITS}{{1,3}}){small}{_READ['process']}{small}{_READ['number']}{small}(20{_DIGITS}{{2}}){small}{tail}(?=[^0-9]|\z)"
    joined = rf"{_READ['unit']}{_READ['family']}([12])({_DIGITS}{{1,3}}){_READ['process']}{_READ['number']}(20{_DIGITS}{{2}}){tail}"
    scattered = (
        rf"(?s){_READ['unit']}.{{0,30}}?{_READ['family']}\s*([12]).{{0,20}}?({_DIGITS}{{1,3}}).{{0,25}}?{_READ['process']}.{{0,10}}?{_READ['number']}.{{0,20}}?(20{_DIGITS}{{2}}).{{0,12}}?{tail}(?=[^0-9]|\z)"
    )

    def found(t: Column, pattern: str, confidence: int) -> Column:
        # parts are read from each match, not each from all of the text: a match alone gives the same parts, since what may follow it does so at its end, too
        code = lambda match: canonical_plan_code(*(F.regexp_extract(match, pattern, k) for k in (1, 2, 3, 4)))
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda match: F.struct(F.lit(confidence).alias("confidence"), code(match).alias("code")))

    def every(t: Column, near: Column) -> Column:
        # no code goes over a dot between two stretches
        dashed, bare = (F.array_join(F.transform(near, lambda x: F.regexp_replace(x, "[^A-Z0-9]+", between)), ".") for between in ("-", ""))
        return F.concat(found(t, direct, DIRECT), found(dashed, direct, DIRECT), found(bare, joined, JOINED), found(t, scattered, SCATTERED))

    def surest(all_: Column) -> Column:
        good = F.filter(all_, lambda x: (x["code"] != "") & is_plan_code(x["code"]))
        return let(good, lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, F.lit(1), i), lambda y: y["code"] == x["code"])))

    # stretches in which a code may begin, most texts have none: from a unit, whatever stands between its letters, on for more letters and digits than a code has
    gap = "[^A-Z0-9]*+"
    unit = gap.join(("U", "[G6]", "P", "[A4]"))
    stretch = rf"(?:{unit}(?:{gap}(?!{unit})[A-Z0-9]){{0,60}}+{gap})++"
    none = F.array().cast("array<struct<confidence:int,code:string>>")
    out = let(F.upper(clean(c)), lambda t: let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(stretch), F.lit(0)).alias("near")), lambda x: F.when(F.size(x["near"]) > 0, surest(every(x["t"], x["near"]))).otherwise(none)))
    return F.transform(out, lambda x: F.struct(x["code"].alias("code"), x["confidence"].alias("confidence")))


def agreement_code(c: Column | str) -> Column:
    """First agreement code of a text, canonical; '' if there is none."""
    part = lambda match, k: F.regexp_extract(match, AGREEMENT_CODE, k)
    value = lambda match, k: F.coalesce(number(part(match, k)), F.lit(0))
    spelled = lambda match: F.concat(part(match, 1), F.lit("-RGI2-"), value(match, 2).cast("string"), F.lit("-PRO-134-"), part(match, 3), F.lit("-"), F.lpad(value(match, 4).cast("string"), 2, "0"))
    return let(F.regexp_extract(F.upper(clean(c)), AGREEMENT_CODE, 0), lambda match: F.when((match != "") & (value(match, 2) > 0), spelled(match)).otherwise(""))


def is_plan_code(c: Column | str) -> Column:
    """Whether a text is a valid plan code; sequence 0 is not."""
    return let(F.upper(clean(c)), lambda t: t.rlike(r"\AUGPA-RGI[12]-[0-9]{2,3}-PRO-251-20[0-9]{2}-(0[1-9]|1[0-2])\z") & ~t.rlike(r"-0+-PRO"))


def period_of(c: Column | str) -> Column:
    """Year and month at the end of a code; '' if there are none."""
    return F.regexp_extract(clean(c), r"(20[0-9]{2}-(?:1[0-2]|0[1-9]))\z", 1)


def month_number(c: Column) -> Column:
    """Number of a Spanish month name or of digits; null otherwise."""
    names = {**{m: k + 1 for k, m in enumerate(MONTHS)}, **MONTH_ALIASES}
    lookup = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.try_element_at(lookup, F.lower(fold_accents(c))), number(c))


def strict_date(year: Column, month: Column, day: Column) -> Column:
    """A date of the calendar from 2000 to 2100; null otherwise."""
    return F.when(year.between(*YEARS), F.to_date(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))))


def spanish_date(c: Column | str) -> Column:
    """struct(iso, original): the date of a signing clause, else of any "d de mes de Y", else d/m/Y; strict calendar, '' if none."""
    word = r"([0-9]{1,2})\s+(?:d[ií]as?\s+)?(?:del?\s+mes\s+)?de\s+([A-Za-zÁÉÍÓÚáéíóú]+|[0-9]{1,2})\s+del?\s+(?:a[ñn]o\s+)?(20[0-9]{2})"
    patterns = (rf"(?iu)a\s+los\s+{word}", rf"(?iu)(?<![0-9]){word}", r"(?<![0-9])([0-9]{1,2})[/\-]([0-9]{1,2})[/\-](20[0-9]{2})(?![0-9])")

    def found(t: Column, p: str) -> Column:
        """The date of a pattern's first match; null if there is none. Parts are read from the match, not each from all of the text."""
        part = lambda match, k: F.regexp_extract(match, p, k)
        dated = lambda match: let(strict_date(number(part(match, 3)), month_number(part(match, 2)), number(part(match, 1))), lambda d: F.when(d.isNotNull(), F.struct(F.date_format(d, "yyyy-MM-dd").alias("iso"), match.alias("original"))))
        return let(F.regexp_extract(t, p, 0), lambda match: F.when(match != "", dated(match)))

    return let(clean(c), lambda t: F.coalesce(*(found(t, p) for p in patterns), F.struct(F.lit("").alias("iso"), F.lit("").alias("original"))))


def loose_date(c: Column | str) -> Column:
    """struct(year, month, day) of a planned date, without a calendar check: ISO, "d de mes de Y", "mes d de Y", "mes Y" (day 1), "Y" (1 January); null if none."""
    return let(normalize(c), loose_date_of)


def loose_date_of(key: Column) -> Column:
    """As :func:`loose_date`, of a normalized text."""
    of = lambda t, pattern, y, m, d: F.struct(
        number(F.regexp_extract(t, pattern, y)).alias("year"),
        (month_number(F.regexp_extract(t, pattern, m)) if m else F.lit(1)).cast("int").alias("month"),
        (number(F.regexp_extract(t, pattern, d)) if d else F.lit(1)).alias("day"),
    )
    name = "(" + "|".join((*MONTHS, *MONTH_ALIASES)) + ")"
    day = r"(0?[1-9]|[12][0-9]|3[01])"
    tries = [
        (rf"\b(20[0-9]{{2}}) (0?[1-9]|1[0-2]) {day}\b", 1, 2, 3),
        (rf"\b{day} de {name} de (20[0-9]{{2}})\b", 3, 2, 1),
        (rf"\b{name} {day} de (20[0-9]{{2}})\b", 3, 1, 2),
        (rf"\b{name} (?:del? )?(20[0-9]{{2}})\b", 2, 1, 0),
        (r"\b(20[0-9]{2})\b", 1, 0, 0),
    ]
    return F.coalesce(*(F.when(key.rlike(p), of(key, p, y, m, d)) for p, y, m, d in tries))


def date_number(d: Column) -> Column:
    """yyyymmdd of a loose date; 0 for none."""
    return F.coalesce(d["year"] * 10000 + d["month"] * 100 + d["day"], F.lit(0))


def date_range(c: Column | str) -> Column:
    """struct(start, end) of "Desde a hasta b" (the first word may be left out or misread); without it, all is the start."""
    t = F.trim(F.regexp_replace(text(c), r"[\s ]+", " "))
    pattern = r"(?iu)\A(?:desd[eo]\s+)?(?:el\s+)?(.*?)\s+(?:hasta|al)\s+(?:el\s+)?(.*)\z"
    hit = t.rlike(pattern)
    return F.struct(F.when(hit, F.trim(F.regexp_extract(t, pattern, 1))).otherwise(t).alias("start"), F.when(hit, F.trim(F.regexp_extract(t, pattern, 2))).otherwise("").alias("end"))
