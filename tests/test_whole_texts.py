"""Long texts: answers at the right place, cleaned values as they are, each text worked on once."""

import random

from pyspark.sql import functions as F

from docloom import catalogue
from docloom.functions.similarity import alias_score
from docloom.functions.text import clean, compact, normalize
from docloom.operators import layout, processing

FOLDER = "/root/testdata/sf0.001"
ASKED = {
    "capacitacion_12_meses": ("¿En qué curso o programa de actualización has participado en los últimos 12 meses", "Has participado recientemente en algún curso o programa de actualización en tu área de enseñanza"),
    "avances_aplicados": ("¿Podrías mencionar uno o más avances recientes en tu campo disciplinar que hayas aplicado en tus clases", "Consideras que tienes suficientes conocimientos sobre las últimas investigaciones o avances en tu disciplina"),
    "comodidad_metodologias": ("¿Qué tan cómodo/a te sientes implementando nuevas metodologías de enseñanza en el aula", "que tan comoda te sientes implementando nuevas metodologias de ensenanza en el aula"),
    "estrategias_pedagogicas": ("¿Qué estrategias pedagógicas innovadoras aplicas en tu práctica docente", "Conoces y aplicas estrategias pedagógicas innovadoras"),
    "herramientas_tecnologicas": ("¿Qué herramientas tecnológicas utilizas regularmente en tu docencia", "Tienes experiencia en la utilización de plataformas virtuales o tecnología educativa"),
    "formacion_adicional": ("¿Qué formación académica adicional consideras necesaria para fortalecer tu perfil profesional",),
    "nivel_academico_actual": ("¿Cuál es tu nivel académico actual (título registrado)", "Cuál es tu nivel académico actual"),
    "tipo_formacion": ("¿La formación académica que propones es específica o genérica",),
}


def test_answers_stand_where_they_are_whatever_comes_before(spark):
    """Characters of two UTF-16 units count once; all forms of a question are known by their word."""
    rows = [(f"{start}{q}?{end}", name) for name, forms in ASKED.items() for q in forms for start, end in (("", " uno"), ("😀 𝒳 a\n* • ", "\n- uno *"))]
    got = spark.createDataFrame(rows, "t string, name string").select("name", processing.question_answers("t").alias("a")).collect()
    assert [r["a"] for r in got] == [{r["name"]: "uno"} for r in got]


def test_what_cleaning_changes(spark):
    texts = ["a\n\nb c\nd", "a  b", "a\n\n\n\nb", " a \n b\t", "\xa0a\xa0\xa0b\xa0", "a—b​c�d", "\r\na\r b", "•x “y” 😀", "a\x0b\x0cb", "", None, " , a  ;b-"]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select(clean("t"), compact("t"), normalize("t"), clean("t", unreadable="", blank_lines=None)).collect()
    assert [tuple(r) for r in row] == [
        ("a\n\nb c\nd", "a b c d", "a b c d", "a\n\nb c\nd"), ("a b", "a b", "a b", "a b"), ("a\n\nb", "a b", "a b", "a\n\n\n\nb"), ("a\nb", "a b", "a b", "a\nb"), ("a\xa0\xa0b", "a b", "a b", "a\xa0\xa0b"), ("a-bc-d", "a-bc-d", "a b c d", "a-bcd"),
        ("a\nb", "a b", "a b", "a\nb"), ("•x “y” 😀", "•x “y” 😀", "x y", "•x “y” 😀"), ("a\x0b\x0cb", "a b", "a b", "a\x0b\x0cb"), ("", "", "", ""), ("", "", "", ""), (", a ;b-", ", a ;b-", "a b", ", a ;b-"),
    ]


def test_page_scores_work_on_each_text_once(spark):
    scores = catalogue.queries()["page_scores"](spark, FOLDER)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]") <= 2  # one pattern may name it twice
    assert scores.where(F.col("signal") > 0).count() > 0


def test_activity_lists_are_read_once(spark):
    plan = catalogue.queries()["activity_assignment"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Pr[aá]cticas?") == 2  # where the first list ends and the second begins


def test_activities_fit_as_their_scores_say(spark):
    rng = random.Random(2)
    words = ["ia", "datos", "Inteligencia", "hacking", "seguridad", "fibra", "a", "x1", "código", "", "redes", "normas  APA"]
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randrange(4)))
    rows = [(k, [(text(),) for _ in range(rng.randrange(5))], [text() for _ in range(rng.randrange(5))]) for k in range(60)] + [(60, None, ["a"]), (61, [("ia",)], None)]
    frame = spark.createDataFrame(rows, "k int, t array<struct<name:string>>, a array<string>")
    got = {r["k"]: r["x"] for r in frame.select("k", layout.assigned_activities(F.col("t"), F.col("a")).alias("x")).collect()}
    pairs = frame.select("k", F.posexplode("t").alias("i", "t"), "a").select("k", "i", "t", F.posexplode("a").alias("j", "a"))
    scored = {(r["k"], r["i"], r["j"]): r["s"] for r in pairs.select("k", "i", "j", alias_score("t.name", "a", layout.ACTIVITY_ALIASES).alias("s")).collect()}
    for k, trainings, listed in rows[:60]:
        best = [max(((scored[k, i, j], -j) for j in range(len(listed))), default=(0, 0)) for i in range(len(trainings))]
        assert [(x["items"], x["shared"]) for x in got[k]] == [([listed[-j]], False) if s else (listed, True) for s, j in best]
    assert got[60] is None and [(x["items"], x["shared"]) for x in got[61]] == [(None, True)]
