"""Figures, page layout and their links to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least width, height and area of an image worth looking at, and placements of distinct images per document.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA = 80, 80, 12_000
CELL = 100.0


def worth_looking_at(images: DataFrame) -> DataFrame:
    """Images that aren't too small."""
    return images.filter((F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT) & (F.col("width") * F.col("height") >= LEAST_AREA))


def within_budget(placements: DataFrame, most: int, order: Sequence[str] = ("page", "place")) -> DataFrame:
    """Every placement of a document's first most distinct images.

    Images are counted by content, so that one used a hundred times costs one; the window sees distinct images only.
    """
    first = placements.groupBy("doc_id", "image_hash").agg(F.min(F.struct(*order)).alias("o"))
    admitted = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "image_hash"))).filter(F.col("n") <= most)
    return placements.join(admitted.select("doc_id", "image_hash"), ["doc_id", "image_hash"], "left_semi")


def outside_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre lies in no box of their page. lines: doc_id, page, line_id, x0, top, x1, bottom.

    Boxes are laid on a grid of cells, so that the containment test only meets lines of the same cell.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    at = lines.select("doc_id", "page", "line_id", cx.alias("cx"), cy.alias("cy"), F.floor(cx / CELL).alias("gx"), F.floor(cy / CELL).alias("gy"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))
    cells = boxes.select("doc_id", "page", "x0", "top", "x1", "bottom", span("x0", "x1").alias("gx")).withColumn("gy", span("top", "bottom"))
    hit = at.join(cells, ["doc_id", "page", "gx", "gy"]).filter("cx between x0 and x1 and cy between top and bottom")
    return lines.join(hit.select("doc_id", "page", "line_id").distinct(), ["doc_id", "page", "line_id"], "left_anti")


def consistent_width(cells: Column, width: Column) -> Column:
    """Whether a grid's row is as wide as its header; to be summed up with bool_and."""
    return F.size(cells) == width


def splits_words(words: DataFrame, cuts: DataFrame) -> DataFrame:
    """A10: pages whose inferred columns cut through words: two at least, and a tenth of them.

    words: doc_id, page, x0, x1; cuts: doc_id, page, x. A word is cut if a cut lies strictly inside it. A page's cuts are
    few: they come as one array per page.
    """
    per = cuts.groupBy("doc_id", "page").agg(F.collect_set("x").alias("xs"))
    met = words.join(per, ["doc_id", "page"])
    cut = F.exists("xs", lambda x: (x > F.col("x0")) & (x < F.col("x1")))
    return met.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if(cut).alias("n_cut")).filter("n_cut >= 2 and n_cut >= 0.1 * n")


def is_heading(text: Column, font: Column, median: Column) -> Column:
    """Set larger than the page by 15 %, or named a section, chapter or appendix."""
    return (font >= 1.15 * median) | F.lower(text).rlike(r"^(section|chapter|appendix)\b")


def is_caption(text: Column) -> Column:
    """J39."""
    return F.lower(F.trim(text)).rlike(r"^fig(?:ure|\.)?\s*\d+")


def nearest_context(figures: DataFrame, lines: DataFrame, above: int = 3, below: int = 3, limit: int = 1200) -> DataFrame:
    """Of each figure the last lines above and the first below on its page, up to limit characters.

    figures: doc_id, page, figure_id, top; lines: doc_id, page, top, text. A page's lines and figures are few.
    """
    met = figures.select("doc_id", "page", "figure_id", F.col("top").alias("at")).join(lines, ["doc_id", "page"])
    up = F.row_number().over(Window.partitionBy("doc_id", "page", "figure_id", F.col("top") < F.col("at")).orderBy(F.abs(F.col("top") - F.col("at")), "text"))
    near = met.withColumn("n", up).filter(F.when(F.col("top") < F.col("at"), F.col("n") <= above).otherwise(F.col("n") <= below))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("top", "text"))), lambda x: x["text"])
    return near.groupBy("doc_id", "page", "figure_id").agg(F.substring(F.array_join(ordered, "\n"), 1, limit).alias("context"))


def page_order(events: DataFrame) -> DataFrame:
    """Texts and figures of each page in reading order: top, left, figures first."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "x0", F.col("kind") != "figure", "event_id")
    return events.withColumn("place", F.row_number().over(order))


def authorised(figures: DataFrame, documents: DataFrame) -> DataFrame:
    """Figures of documents that the caller may see, whatever the figures' own rows say."""
    return figures.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def answer_images(citations: DataFrame, most: int) -> DataFrame:
    """Figures that an answer cites, each once where it is cited first, the first most."""
    first = citations.filter("figure_id is not null").groupBy("doc_id", "figure_id").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return first.orderBy("ordinal", "doc_id", "figure_id").limit(most)


def index_entries(figures: DataFrame, size: int = 1400, overlap: int = 150) -> DataFrame:
    """Long figure texts in overlapping parts, each under its label."""
    step = size - overlap
    parts = F.when(F.length("text") <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - overlap), F.lit(step)))
    cut = figures.withColumn("start", F.explode(parts))
    return cut.select("doc_id", "figure_id", "start", F.concat(F.lit("Figure "), F.col("figure_id").cast("string"), F.lit(":\n"), F.expr(f"substring(text, start, {size})")).alias("entry"))
