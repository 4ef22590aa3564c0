import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import codes, quality, similarity, text
from docloom.functions.register import register


def value(spark, column, **row):
    names = list(row) or ["x"]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(row.values()) or (None,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [(None, ""), ("", ""), ("  a \t b ", "a b"), ("a­​b", "ab"), ("a—b–c", "a-b-c"), ("a\r\nb\rc", "a\nb\nc"), ("a \n  b", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("�x", "-x")],
)
def test_clean(spark, raw, want):
    assert value(spark, text.clean("x"), x=raw) == want


def test_normalize_matches_nfd(spark):
    words = ["Ñandú-Á É", "Ingeniería en SISTEMAS", "  ", "a_b", "Ǖ ẍ", "éa"]
    got = [r["v"] for r in spark.createDataFrame([(w,) for w in words], "x string").select(text.normalize("x").alias("v")).collect()]

    def model(w):
        plain = "".join(c for c in unicodedata.normalize("NFD", w) if not "̀" <= c <= "ͯ")
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()).lower()

    assert got == [model(w) for w in words]


@pytest.mark.parametrize("raw, want", [("JUAN DE LA CRUZ", "Juan de la Cruz"), ("Juan DE la Cruz", "Juan DE la Cruz"), ("", ""), (None, ""), ("- DEL SOL", "Del Sol"), ("123", "123")])
def test_smart_case(spark, raw, want):
    assert value(spark, text.smart_case("x"), x=raw) == want


def test_lists(spark):
    assert value(spark, text.lines("x"), x=" a \n\n b") == ["a", "b"]
    assert value(spark, text.split_list("x"), x="a | b\n|c") == ["a", "b", "c"]
    assert value(spark, text.display("x", "none"), x="  ") == "none"


def test_four_similarities_differ(spark):
    row = {"a": "Ana María López", "b": "ana maria lopes"}
    assert value(spark, similarity.edit_ratio("a", "b"), **row) == pytest.approx(1 - 1 / 15)
    assert value(spark, similarity.token_overlap("a", "b", 2), **row) == pytest.approx(2 / 3)
    assert value(spark, similarity.token_overlap("a", "b", 1), a="yo tu", b="tu") == 0.5
    assert value(spark, similarity.alias_score("a", "b", [("cold", "frozen")]), a="cold tv", b="frozen tv") == 5
    assert value(spark, similarity.edit_ratio("a", "b"), a="", b="x") == 0.0
    left = F.array(F.lit("abc"), F.lit("zzz"))
    assert value(spark, similarity.mean_best(left, F.array(F.lit("abc")))) == 0.5
    assert value(spark, similarity.mean_best(F.array(F.lit("abc")), left)) == 1.0


@pytest.mark.parametrize(
    "raw, want",
    [
        ("UGPA-RGI1-44-PRO-251-2025-12", "UGPA-RGI1-44-PRO-251-2025-12"), ("UGPA_RGI1_44_PRO_251_2025_12", "UGPA-RGI1-44-PRO-251-2025-12"), ("x ugpa rgi2 7 pro 251 202S 3.", "UGPA-RGI2-07-PRO-251-2025-03"),
        ("UGPA-RGI1-007-PRO-251-2025-12", "UGPA-RGI1-07-PRO-251-2025-12"), ("UGPA-RGI1-00-PRO-251-2025-12", ""), ("UGPA-RGI1-44-PRO-251-2025-13", ""), ("UGPA-RGI1-44-\nPRO-251-2025-12", "UGPA-RGI1-44-PRO-251-2025-12"), (None, ""),
    ],
)
def test_plan_code(spark, raw, want):
    assert value(spark, codes.plan_code("x"), x=raw) == want


def test_other_codes(spark):
    assert value(spark, codes.agreement_code("x"), x="CGC_RGI2_159_PRO_134_2024_11") == "CGC-RGI2-159-PRO-134-2024-11"
    assert value(spark, codes.is_plan_code("x"), x="UGPA-RGI1-000-PRO-251-2025-12") is False
    assert value(spark, codes.period_of("x"), x="UGPA-RGI1-44-PRO-251-2025-12") == "2025-12"
    assert value(spark, codes.period_of("x"), x="nothing") == ""
    assert value(spark, codes.plan_codes("x"), x="UGPA-RGI1-44-PRO-251-2025-12 UGPA-RGI1-44-PRO-251-2025-12 ") == ["UGPA-RGI1-44-PRO-251-2025-12"] * 2
    assert value(spark, text.numeric_ocr("x"), x="O1I-SB|") == "011581"


@pytest.mark.parametrize(
    "raw, iso", [("a los 5 días del mes de marzo de 2024", "2024-03-05"), ("el 31 de febrero de 2024", ""), ("firmado 07/11/2024", "2024-11-07"), ("1 de setiembre de 2023", "2023-09-01"), ("nada", ""), (None, ""), ("2 de enero de 2024, a los 3 de mayo de 2025", "2025-05-03")]
)
def test_spanish_date(spark, raw, iso):
    assert value(spark, codes.spanish_date("x")["iso"], x=raw) == iso


@pytest.mark.parametrize("raw, number", [("2025-03-10", 20250310), ("el 3 de mayo de 2025", 20250503), ("mayo 3 de 2025", 20250503), ("junio del 2025", 20250601), ("año 2025", 20250101), ("10/03/2025", 20250101), ("pronto", 0), (None, 0)])
def test_loose_date(spark, raw, number):
    assert value(spark, codes.date_number(codes.loose_date("x")), x=raw) == number


def test_date_range(spark):
    assert tuple(value(spark, codes.date_range("x"), x="Desde  marzo hasta  mayo")) == ("marzo", "mayo")
    assert tuple(value(spark, codes.date_range("x"), x="Desdo el 1 al 2")) == ("1", "2")
    assert tuple(value(spark, codes.date_range("x"), x="marzo")) == ("marzo", "")


def test_quality(spark):
    assert value(spark, quality.text_quality("x"), x="") == -1000
    assert value(spark, quality.text_quality("x"), x="a" * 25) == 3
    assert value(spark, quality.text_quality("x"), x="Total de horas 40") == 2 - 80
    assert value(spark, quality.text_quality("x"), x="UGPA-RGI1 a�") == 2 - 35 - 20
    assert value(spark, quality.has_mixed_content("x"), x="5. Indicadores de logro") is True
    assert value(spark, quality.has_mixed_content("x"), x="15 indicadores") is False
    assert value(spark, quality.has_mixed_content("x", 3), x="abcd") is True
    assert value(spark, quality.signal_score("x", {"plan de": 2, "horas": 1}), x="Plan  DE horas") == 3


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT normalize_text('Ñ  a') a, edit_ratio('abc', 'abd') b, token_overlap('una casa', 'casa', 2) c, normalize_text(NULL) d").first()
    assert (row["a"], round(row["b"], 4), row["c"], row["d"]) == ("n a", 0.6667, 0.5, "")
