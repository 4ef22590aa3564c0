"""Page geometry: word boxes to lines, regions, table rows and columns.

words: doc_id, page, text, left, top, width, height, right, bottom, center_x, center_y, confidence.
The greedy steps depend on the order of the words; they run on one page at a time, which is small.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, clean, normalize, number, text
from .groups import per_group

PAGE = ["doc_id", "page"]
# Right ends of the first four of the five table columns, as shares of the width.
COLUMN_ENDS = {"number": 0.085, "name": 0.445, "hours": 0.585, "date": 0.775}
LAST_COLUMN = "type"
ANCHOR_BAND, ANCHOR_REACH = 18.0, 0.15
FIRST_ROW_REACH, LAST_ROW_REACH = 45.0, 60.0
# The least height of a text run, and how wide a character is at least for its height.
LEAST_HEIGHT, CHARACTER_SHAPE = 5.0, 0.38


def with_box(words: DataFrame) -> DataFrame:
    """Adds right, bottom and the centre to words with left, top, width, height."""
    return words.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height"), "center_x": F.col("left") + F.col("width") / 2, "center_y": F.col("top") + F.col("height") / 2})


def item_runs(items: DataFrame) -> DataFrame:
    """Text runs of a page's text items (PAGE, run, text, x, baseline, width, height, page_height): heights count from the top, also where an item's own is negative; 10 where it has none."""
    height = F.greatest(F.abs(F.coalesce("height", F.lit(10.0))), F.lit(LEAST_HEIGHT))
    top = F.greatest(F.lit(0.0), F.col("page_height") - F.coalesce("baseline", F.lit(0.0)) - height)
    return items.select(*PAGE, "run", "text", F.coalesce("x", F.lit(0.0)).alias("left"), top.alias("top"), F.coalesce("width", F.lit(0.0)).alias("width"), height.alias("height"))


def split_runs(runs: DataFrame) -> DataFrame:
    """Word boxes of text runs (PAGE, run, text, left, top, width, height): the width goes to the words by their characters, a gap counts as one.

    A run is as wide as its characters need at least; no word is narrower than two units. Runs without a word give none.
    """
    tall = runs.withColumn("height", F.greatest("height", F.lit(LEAST_HEIGHT))).withColumn("t", clean("text")).where("t <> ''")
    wide = F.greatest(F.col("width"), F.length("t") * F.greatest(F.lit(3.0), F.col("height") * CHARACTER_SHAPE))
    words = tall.withColumn("words", F.split("t", SPACE + "+")).withColumn("unit", wide / (F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w)) + F.size("words") - 1))
    sized = words.withColumn("sizes", F.transform("words", lambda w: F.greatest(F.lit(2.0), F.length(w) * F.col("unit"))))
    before = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0.0), lambda s, x: s + x + F.col("unit")))
    each = sized.select(*PAGE, "run", "left", "top", "height", F.posexplode(F.arrays_zip("words", "sizes", before.alias("before"))).alias("pos", "x"))
    boxes = each.select(*PAGE, "run", "pos", F.col("x.words").alias("text"), (F.col("left") + F.col("x.before")).alias("left"), "top", F.col("x.sizes").alias("width"), "height", F.lit(100.0).alias("confidence"))
    return with_box(boxes)


def words_inside(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words whose centre lies in a region of their page (edges included). regions: PAGE, region, left, top, width, height."""
    r = regions.select(*PAGE, "region", *(F.col(c).alias(f"r_{c}") for c in ("left", "top", "width", "height")))
    inside = F.col("center_x").between(F.col("r_left"), F.col("r_left") + F.col("r_width")) & F.col("center_y").between(F.col("r_top"), F.col("r_top") + F.col("r_height"))
    return words.join(r, PAGE).where(inside).drop("r_left", "r_top", "r_width", "r_height")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines as the OCR engine numbered them (block, paragraph, line): text in reading order and bounding box."""
    parts = F.array_sort(F.collect_list(F.struct("left", "word", "text")))
    return words.groupBy(*PAGE, "block", "paragraph", "line").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("n_words")
    )


def cluster_lines(centers: list[float], tolerances: list[float]) -> list[int]:
    """Greedy lines: each word, from the top, joins the first line whose running mean height is near enough; lines are numbered downwards."""
    means, sizes, of = [], [], []
    for y, tolerance in zip(centers, tolerances):
        at = next((k for k, m in enumerate(means) if abs(m - y) <= tolerance), None)
        if at is None:
            at = len(means)
            means.append(y)
            sizes.append(1)
        else:
            sizes[at] += 1
            means[at] += (y - means[at]) / sizes[at]
        of.append(at)
    place = {k: n for n, k in enumerate(sorted(range(len(means)), key=lambda k: means[k]))}
    return [place[k] for k in of]


def _lines_of(centers: pa.Array, tolerances: pa.Array) -> pa.Array:
    """:func:`cluster_lines` of pages."""
    return pa.array(map(cluster_lines, centers.to_pylist(), tolerances.to_pylist()), pa.list_(pa.int32()))


def visual_lines(words: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Adds visual_line (0-based, downwards). tolerance None: by the height of each word, 2.5 to 7."""

    # only heights and tolerances go to Python; pages that are dealt already are not shuffled again
    near = F.lit(tolerance) if tolerance is not None else F.least(F.lit(7.0), F.greatest(F.lit(2.5), F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(10.0)) * 0.55))
    rest = [c for c in words.columns if c not in PAGE]
    word = F.struct("center_y", "left", near.alias("near"), F.struct(*rest).alias("word"))
    pages = words.where(F.trim(text("text")) != "").groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("x"))
    each = pages.select(*PAGE, "x", F.arrow_udf(_lines_of, T.ArrayType(T.IntegerType()))("x.center_y", "x.near").alias("n")).select(*PAGE, F.explode(F.arrays_zip("x", "n")).alias("e"))
    return each.select(*(F.col(c) if c in PAGE else F.col(f"e.x.word.{c}").alias(c) for c in words.columns), F.col("e.n").alias("visual_line"))


def line_text(lined: DataFrame, line: str = "visual_line") -> DataFrame:
    """Text and bounding box of each line of :func:`visual_lines`."""
    parts = F.array_sort(F.collect_list(F.struct("left", "text")))
    return lined.groupBy(*PAGE, line).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def pick_anchors(candidates: list[tuple[float, float]]) -> list[int]:
    """Greedy anchors from (height, confidence), downwards: one for each band; a more confident one replaces the one that is kept."""
    kept: list[int] = []
    for k, (y, confidence) in enumerate(candidates):
        at = next((n for n, i in enumerate(kept) if abs(candidates[i][0] - y) < ANCHOR_BAND), None)
        if at is None:
            kept.append(k)
        elif confidence > candidates[kept[at]][1]:
            kept[at] = k
    return kept


def row_anchors(words: DataFrame) -> DataFrame:
    """Words that number the rows of a table: 1 to 30, in the left 15 per cent of the width (column page_width)."""
    ordinal = number(F.regexp_extract(F.trim("text"), r"\A([0-9]{1,2})\z", 1))
    near = words.withColumn("number", ordinal).where((F.col("center_x") / F.col("page_width") <= ANCHOR_REACH) & F.col("number").between(1, 30))

    picked = lambda found: [found[k] for k in pick_anchors([(w["center_y"], w["confidence"]) for w in found])]
    return per_group(near, PAGE, ["center_y", "left"], picked, near.schema)


def row_bands(anchors: DataFrame) -> DataFrame:
    """PAGE, number, band_top, band_bottom: half-way to the neighbours; at the edges half a gap, or a fixed reach for a single row."""
    w = W.partitionBy(*PAGE).orderBy("center_y")
    y, before, after = F.col("center_y"), F.lag("center_y").over(w), F.lead("center_y").over(w)
    top = F.coalesce((before + y) / 2, y - F.coalesce((after - y) / 2, F.lit(FIRST_ROW_REACH)))
    bottom = F.coalesce((after + y) / 2, y + F.coalesce((y - before) / 2, F.lit(LAST_ROW_REACH)))
    return anchors.select(*PAGE, "number", top.alias("band_top"), bottom.alias("band_bottom"))


def column_of(ratio: Column) -> Column:
    """Table column by the share of the width."""
    out = None
    for name, end in COLUMN_ENDS.items():
        out = F.when(ratio <= end, name) if out is None else out.when(ratio <= end, name)
    return out.otherwise(LAST_COLUMN)


def table_cells(words: DataFrame) -> DataFrame:
    """PAGE, ordinal and the text of the five cells of each table row."""
    bands = row_bands(row_anchors(words)).withColumnRenamed("number", "ordinal")
    placed = words.join(bands, PAGE).where((F.col("center_y") >= F.col("band_top")) & (F.col("center_y") < F.col("band_bottom")))
    parts = F.array_sort(F.collect_list(F.struct("center_y", "left", "text")))
    cells = placed.withColumn("cell", column_of(F.col("center_x") / F.col("page_width"))).groupBy(*PAGE, "ordinal").pivot("cell", [*COLUMN_ENDS, LAST_COLUMN]).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " "))
    return cells.fillna("", [*COLUMN_ENDS, LAST_COLUMN])


def section_boxes(lines: DataFrame, starts: str, ends: str) -> DataFrame:
    """Region of a section on each page (lines: PAGE, page_width, page_height, text, top, bottom): from its heading to the next end heading, else 45 per cent of the page; patterns on normalized text."""
    key = normalize("text")
    marked = lines.withColumn("is_start", key.rlike(starts)).withColumn("is_end", key.rlike(ends))
    first = marked.where("is_start").groupBy(*PAGE).agg(F.min(F.struct("top", "bottom", "page_width", "page_height")).alias("s"))
    joined = first.join(marked.where("is_end").select(*PAGE, F.col("top").alias("e_top")), PAGE, "left").withColumn("e_top", F.when(F.col("e_top") > F.col("s.bottom"), F.col("e_top")))
    box = joined.groupBy(*PAGE, "s").agg(F.min("e_top").alias("end"))
    top = F.greatest(F.lit(0.0), F.col("s.top") - 3)
    bottom = F.least(F.col("s.page_height"), F.coalesce(F.col("end") + 2, F.col("s.bottom") + F.col("s.page_height") * 0.45))
    return box.select(*PAGE, (F.col("s.page_width") * 0.02).alias("left"), top.alias("top"), (F.col("s.page_width") * 0.96).alias("width"), F.greatest(F.lit(20.0), bottom - top).alias("height"))


def header_corner(words: DataFrame) -> DataFrame:
    """Text in the upper right corner of first pages, in reading order: where the document code stands."""
    near = words.where((F.col("page") == 1) & (F.col("center_x") >= F.col("page_width") * 0.68) & (F.col("center_y") <= F.col("page_height") * 0.23))
    parts = F.array_sort(F.collect_list(F.struct("center_y", "left", "text")))
    return near.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def tsv_words(pages: DataFrame) -> DataFrame:
    """Word boxes of an OCR engine's tab-separated output. pages: doc_id, tsv, and left and top of the region that was read.

    The first line names the columns. Lines of too few columns, without a text or without a number
    for the confidence (-1 at least) are no words.
    """
    line = pages.select("doc_id", "left", "top", F.posexplode(F.split(F.trim(text("tsv")), r"\r?\n")).alias("at", "line")).where("at > 0")
    cells = line.withColumn("c", F.split("line", "\t")).where(F.size("c") >= 12)
    value = lambda k: F.coalesce(number(F.get("c", k), "double"), F.lit(0.0))
    whole = lambda k: value(k).cast("int")
    words = cells.select(
        "doc_id", whole(1).alias("page"), whole(2).alias("block"), whole(3).alias("paragraph"), whole(4).alias("line"), whole(5).alias("word"), F.trim(F.array_join(F.slice("c", 12, F.size("c")), "\t")).alias("text"),
        (value(6) + F.col("left")).alias("left"), (value(7) + F.col("top")).alias("top"), value(8).alias("width"), value(9).alias("height"), number(F.get("c", 10), "double").alias("confidence"),
    )
    return with_box(words.where("text <> '' and confidence >= -1"))


def page_regions(lines: DataFrame) -> DataFrame:
    """The regions of each page that its lines (PAGE, page_width, page_height, text, top, bottom) name: PAGE, region, left, top, width, height.

    header and code on the first two pages; table (a fixed part of the page where only its column
    headings stand), activities, impact and vision from their headings to the next.
    """
    size = lines.groupBy(*PAGE).agg(F.first("page_width").alias("w"), F.first("page_height").alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), "\n").alias("t"))

    def fixed(name: str, where: Column, left: float, top: float, width: float, height: float) -> DataFrame:
        return size.where(where).select(*PAGE, F.lit(name).alias("region"), (F.col("w") * left).alias("left"), (F.col("h") * top).alias("top"), (F.col("w") * width).alias("width"), (F.col("h") * height).alias("height"))

    key, front = normalize("t"), F.col("page") <= 2
    starts = {
        "table": (r"\A(?=.*resumen)(?=.*capacitacion)(?=.*propuesta)", "indicadores"), "activities": (r"(?:\A| )6 actividades(?: |\z)|\Aactividades\z", "impacto esperado en el docente|7 impacto esperado"),
        "impact": ("impacto esperado en el docente|7 impacto esperado", "vision a largo plazo|8 vision"), "vision": ("vision a largo plazo|8 vision", "formacion docente"),
    }
    found = {name: section_boxes(lines, a, b).select(*PAGE, F.lit(name).alias("region"), "left", "top", "width", "height") for name, (a, b) in starts.items()}
    other = fixed("table", key.contains("capacitacion propuesta") & key.contains("horas"), 0.02, 0.04, 0.96, 0.64).join(found["table"].select(*PAGE), PAGE, "left_anti")
    out = fixed("header", front, 0, 0, 1, 0.22).union(fixed("code", front, 0.48, 0, 0.52, 0.24)).union(other)
    for part in found.values():
        out = out.union(part)
    return out
