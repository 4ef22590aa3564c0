"""Text cleaning and normalization as column expressions.

An absent text is the empty text: every function here maps null to ``''``, as extraction columns do.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

INVISIBLE = "­​‌‍﻿"
DASHES = "‐‑‒–—―"
UNREADABLE = "\x00￾￿�"
#: Words that stay in lower case inside a title.
CONNECTORS = ("de", "del", "e", "en", "la", "las", "los", "y")


def _fold_table() -> tuple[str, str]:
    """Accented letters of the Latin blocks and the ASCII letters they decompose to."""
    source, target = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and base.isascii() and base.isalpha() and all(0x0300 <= ord(m) <= 0x036F for m in marks):
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, BASE = _fold_table()
#: Java character classes: white space with the no-break space; a word edge that takes accented letters for separators.
SPACE = r"[\s ]"
#: A character that cleaning leaves as it is wherever it stands (some rare ones that it leaves, too, are not among them), and the white space that it trims.
_BASIC = r"!-~\x{A1}-\x{AC}\x{AE}-\x{1FFF}\x{2016}-\x{FEFE}\x{FF00}-\x{FFFC}"
PLAIN = rf"[{_BASIC}\x{{10000}}-\x{{10FFFF}}]"
#: A text on one line that cleaning does not change, as most are: such characters (of one unit), one blank between words.
TIDY = rf"\A(?:[{_BASIC}]++(?: (?=[{_BASIC}]))?+)*+\z"
WHITE = " \t\n\x0b\f\r\xa0"
EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def built_once(make: Callable) -> Callable:
    """make, whose result (columns, from hashable arguments) is built once a Spark context: large expressions cost thousands of calls to the JVM."""
    held: dict = {}

    @functools.wraps(make)
    def get(*args):
        context = SparkContext._active_spark_context
        if held.get("context") is not context:
            held.clear()
            held["context"] = context
        if args not in held:
            held[args] = make(*args)
        return held[args]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, however often the body names it; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), 0)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value): as it stands for a plain column, as :func:`let` has it for an expression that the body would repeat."""
    return body(value) if len(repr(value)) < 100 else let(value, body)


def text(c: Column | str) -> Column:
    """The column as text, '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column, kind: str = "int") -> Column:
    """The number that a text spells; null if none. A text without a digit isn't tried: what fails is an exception inside, which costs more than all the rest of a row."""
    return once(c, lambda t: F.when(t.rlike("(?i)[0-9]|nan|inf"), t.try_cast(kind)))


def clean(c: Column | str, unreadable: str | None = "-", blank_lines: int | None = 1) -> Column:
    """Readable text: no invisible characters, plain dashes, LF line ends, single blanks, trimmed.

    unreadable: what stands for characters an engine could not read (None keeps them);
    blank_lines: most blank lines in a row (None keeps all).
    """

    # a text that cleaning does not change, as most are: plain characters, one blank or few line ends between them
    feeds = r"\n++" if blank_lines is None else r"\n{1,%d}+" % (blank_lines + 1)
    tidy = rf"\A(?:{PLAIN}++(?:(?: |{feeds})(?={PLAIN}))?+)*+\z"

    def tidied(c: Column) -> Column:
        # the patterns match only what they change: a match costs more than what it is looked for in
        if unreadable is not None:
            c = F.regexp_replace(c, r"[\x00\x{FFFD}-\x{FFFF}]", unreadable)
        c = F.regexp_replace(c, r"[\x{2010}-\x{2015}]", "-")
        c = F.regexp_replace(c, r"[\x{AD}\x{200B}-\x{200D}\x{FEFF}]+", "")
        c = F.regexp_replace(c, r"\r\n?", "\n")
        c = F.regexp_replace(c, r"[ \t](?:[ \t]++|(?<! ))", " ")
        c = F.regexp_replace(c, r"\n | \n ?", "\n")
        if blank_lines is not None:
            c = F.regexp_replace(c, r"\n{%d,}" % (blank_lines + 2), "\n" * (blank_lines + 1))
        return F.btrim(c, F.lit(WHITE))

    return once(text(c), lambda t: F.when(t.rlike(tidy), t).otherwise(tidied(t)))


def compact(c: Column | str, **options) -> Column:
    """Cleaned text on one line."""
    joined = lambda t: F.trim(F.regexp_replace(clean(t, **options), rf"{SPACE}(?:{SPACE}++|(?<! ))", " "))
    return once(text(c), lambda t: F.when(t.rlike(TIDY), t).otherwise(joined(t)))


def fold_accents(c: Column | str) -> Column:
    """Accented Latin letters as their base letters; combining marks go."""
    folded = lambda t: F.regexp_replace(F.translate(t, ACCENTED, BASE), r"[\u0300-\u036f]", "")
    return once(text(c), lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(folded(t)))


def normalize(c: Column | str) -> Column:
    """Matching key: accents folded, lower case, everything but letters and digits one blank."""
    # a blank between letters stays as it is
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9](?:[^a-z0-9]++|(?<! ))", " "))


def tokens(c: Column | str, longer_than: int = 0) -> Column:
    """Distinct tokens of the normalized text that have more than so many characters."""
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda t: F.length(t) > longer_than))


def smart_case(c: Column | str, connectors: tuple[str, ...] = CONNECTORS) -> Column:
    """Title case for texts all in capitals; any other text as it is."""
    small = lambda w, i: (i > 0) & w.isin(*connectors)
    title = lambda line: F.transform(F.split(F.lower(line), " "), lambda w, i: F.when(small(w, i), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))))
    capitals = lambda line: line.rlike("[A-ZÁÉÍÓÚÜÑ]") & ~line.rlike("[a-záéíóúüñ]")
    # bare, the line would be worked out for each of the places that read it
    return let(F.regexp_replace(compact(c), r"\A[:\-]+\s*", ""), lambda line: F.when(capitals(line), F.array_join(title(line), " ")).otherwise(line))


def numeric_ocr(c: Column | str) -> Column:
    """Digits of a number read by OCR: letters that look like digits are read as such, the rest goes."""
    return F.regexp_replace(F.translate(F.upper(text(c)), "OQIL|SB", "0011158"), "[^0-9]", "")


def lines(c: Column | str) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def split_list(c: Column | str) -> Column:
    """Items of a hand-written list: by line or bar, trimmed, none empty."""
    return F.filter(F.transform(F.split(text(c), r"[\n|]"), lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column | str, separator: str = " | ") -> Column:
    return F.array_join(c, separator)


def display(c: Column | str, fallback: str) -> Column:
    """Trimmed text, or the fallback where there is none."""
    t = F.trim(text(c))
    return F.when(t == "", fallback).otherwise(t)


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)
