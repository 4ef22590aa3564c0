"""Quality scores and content predicates of extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import is_plan_code
from .text import EDGE_AFTER, EDGE_BEFORE, clean, fold_accents, let, normalize

# Phrases (normalized) of the form that show that a field holds text of another part of it.
FOREIGN_PHRASES = (
    "resumen de capacitacion",
    "nombre de capacitacion propuesta",
    "horas de capacitacion",
    "fecha de propuesta de ejecucion",
    "total de horas",
    "cumplimiento del indicador",
    "porcentaje de capacitaciones",
    "instrumento de evaluacion",
    "formacion docente",
)
# Fixed value: a numbered heading of sections 3 to 8.
FOREIGN_HEADING = "[3-8] (?:evaluacion(?:es)?|resumen|indicador(?:es)?|actividad(?:es)?|impacto|vision)"
#: Either of them in a normalized text, as whole words.
FOREIGN = "(?:\\A| )(?:" + "|".join((*FOREIGN_PHRASES, FOREIGN_HEADING)) + ")(?: |\\z)"


def has_phrase(key: Column, *phrases: str) -> Column:
    """Whether a normalized text holds one of the phrases, as whole words."""
    return key.rlike("(?:\\A| )(?:" + "|".join(phrases) + ")(?: |\\z)")


def has_mixed_content(c: Column | str, longest: int = 700) -> Column:
    """Whether a field is too long or holds headings or phrases of other parts of the form."""
    return (F.length(clean(c)) > longest) | normalize(c).rlike(FOREIGN)


def value_score(c: Column | str) -> Column:
    """0 to 20 by length."""
    return F.least(F.lit(20), F.ceil(F.length(clean(c)) / 8)).cast("int")


def text_quality(c: Column | str) -> Column:
    """0 to 24 by length, less 80 for foreign content, 35 for a document code, 20 for unreadable characters; -1000 for no text."""
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    foreign = normalize(c).rlike(FOREIGN)

    def scored(t: Column) -> Column:
        score = F.least(F.lit(24), F.ceil(F.length(t) / 10)).cast("int")
        score -= F.when(foreign, 80).otherwise(0)
        score -= F.when(F.upper(t).rlike(EDGE_BEFORE + "UGPA-RGI[12]" + EDGE_AFTER), 35).otherwise(0)
        score -= F.when(raw.rlike("[�￾]"), 20).otherwise(0)
        return F.when(t == "", -1000).otherwise(score)

    return let(clean(c), scored)


def field_quality(kind: str, c: Column) -> Column:
    """Quality of a value by the kind of its field: code, period, name, or free text."""
    t = clean(c)
    if kind == "code":
        q = F.when(is_plan_code(t), 80).otherwise(-80)
    elif kind == "period":
        q = F.when(t.rlike(r"\A20[0-9]{2}-(0[1-9]|1[0-2])\z"), 40).otherwise(-40)
    elif kind == "name":
        q = F.when(F.length(t) <= 140, 25 + F.least(F.lit(10), F.size(F.split(t, r"\s+")))).otherwise(-50)
    else:
        return text_quality(c)
    return F.when(t == "", -1000).otherwise(q)


def signal_score(c: Column | str, weights: dict[str, int]) -> Column:
    """Sum of the weights of the phrases (normalized) that a text holds."""
    return signal_of_key(normalize(c), weights)


def signal_of_key(key: Column, weights: dict[str, int]) -> Column:
    """:func:`signal_score` of a normalized text."""
    return let(F.concat(F.lit(" "), key, F.lit(" ")), lambda words: sum((F.when(words.contains(f" {phrase} "), weight).otherwise(0) for phrase, weight in weights.items()), F.lit(0)))


# What a text layer with positions says of a plan; of each line the first alternative counts whose phrases (normalized) a text holds, in or out of words.
POSITIONAL_SIGNALS = (
    ((4, ("plan individual de formacion y capacitacion",)), (2, ("plan individual", "formacion"))),
    ((3, ("pro 251",)),),
    ((1, ("nombre docente",)), (1, ("docente", "carrera"))),
    ((2, ("resumen de capacitacion",)), (2, ("capacitacion propuesta",))),
    ((1, ("impacto esperado",)), (1, ("vision a largo plazo",))),
)
USABLE_LENGTH, USABLE_SIGNAL = 550, 5


def positional_signal(c: Column | str) -> Column:
    """How much a text layer with positions looks like a plan, 0 to 11."""
    return let(normalize(c), positional_signal_of_key)


def positional_signal_of_key(key: Column) -> Column:
    """:func:`positional_signal` of a normalized text."""

    def points(alternatives: tuple) -> Column:
        out = F.lit(0)
        for weight, phrases in reversed(alternatives):
            holds = F.lit(True)
            for phrase in phrases:
                holds = holds & key.contains(phrase)
            out = F.when(holds, weight).otherwise(out)
        return out

    return sum((points(a) for a in POSITIONAL_SIGNALS), F.lit(0))


def is_usable_layer(c: Column | str) -> Column:
    """Whether a text layer with positions is long enough and looks like a plan."""
    return usable_layer(F.length(clean(c)), positional_signal(c))


def usable_layer(length: Column, signal: Column) -> Column:
    """:func:`is_usable_layer` by the length of the cleaned text and its signal."""
    return (length >= USABLE_LENGTH) & (signal >= USABLE_SIGNAL)


def markers(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns (Java, on accent-folded lower-case text) a text matches."""
    return let(F.lower(fold_accents(c)), lambda t: sum((t.rlike(p).cast("int") for p in patterns), F.lit(0)))


def readable(c: Column | str, least: int, patterns: tuple[str, ...], hits: int) -> Column:
    """Whether a text layer is good enough: so many characters and so many markers."""
    return (F.length(clean(c)) >= least) & (markers(c, patterns) >= hits)
