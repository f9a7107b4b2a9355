"""Reading order and text sections of pages.

``blocks(doc_id, page_num, block_idx, x0, y0, x1, y1, text, width, height)``; width and height are the page's.
Everything is keyed by page, so the largest group is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.config import SIMILAR_SIZE, TEXT_OVERLAP, LayoutConfig
from quirefold.functions import geometry as g, text as t

PAGE = ["doc_id", "page_num"]


def column_anchors(xs: Column, tolerance: float) -> Column:
    """For a sorted array of left edges, the edge that opens each one's column: the first within ``tolerance`` not in a column yet."""
    start = F.array().cast("array<double>")
    return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), F.element_at(acc, -1)).otherwise(x))))


def with_columns(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``blocks`` large enough to keep, with ``anchor``: the left edge of their column."""
    kept = blocks.where(g.large_enough(g.box(), config.min_block_size_px))
    xs = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_set("x0")).alias("xs"))
    pairs = xs.select(*PAGE, F.explode(F.arrays_zip(F.col("xs").alias("x0"), column_anchors(F.col("xs"), config.column_tolerance).alias("anchor"))).alias("p"))
    return kept.join(pairs.select(*PAGE, F.col("p.x0").alias("x0"), F.col("p.anchor").alias("anchor")), [*PAGE, "x0"])


def reading_order(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``blocks`` with ``anchor`` and ``position`` (from 1): columns from left to right, top to bottom in each."""
    order = Window.partitionBy(*PAGE).orderBy("anchor", "y0", "x0", "block_idx")
    return with_columns(blocks, config).withColumn("position", F.row_number().over(order))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``blocks`` that neither lie in a box of ``tables(doc_id, page_num, x0..y1)`` of their page nor nearly coincide with one of similar size."""
    box, other = g.Box(*(blocks[c] for c in ("x0", "y0", "x1", "y1"))), g.box(suffix="_t")
    near = g.overlaps(box, other) & (g.iou(box, other) > TEXT_OVERLAP) & (g.size_difference(box, other) <= SIMILAR_SIZE)
    tables = tables.select(*(F.col(c).alias(f"{c}_t") for c in (*PAGE, "x0", "y0", "x1", "y1")))
    return blocks.join(tables, [blocks[c] == tables[f"{c}_t"] for c in PAGE] + [g.contains(other, box) | near], "left_anti")


def text_sections(blocks: DataFrame, config: LayoutConfig = LayoutConfig(), tables: DataFrame | None = None) -> DataFrame:
    """Texts of a page in reading order: inside the safe area, not blank, spaces normalised, hyphens fixed; with counts.

    With ``tables`` (off by default) texts that repeat a table's area go too, after the order is set.
    """
    ordered = reading_order(blocks, config).where(~g.touches_margin(g.box(), F.col("width"), F.col("height"), config) & (t.strip(F.col("text")) != ""))
    if tables is not None:
        ordered = outside_tables(ordered, tables)
    spaced = ordered.withColumn("text", t.normalise_spaces(F.col("text")))
    if config.hyphen_fix:
        spaced = spaced.withColumn("hyphens_fixed", t.count_hyphens(F.col("text"))).withColumn("text", t.fix_hyphens(F.col("text")))
    else:
        spaced = spaced.withColumn("hyphens_fixed", F.lit(0).cast("long"))
    return spaced.withColumns({"word_count": t.count_words(F.col("text")), "char_count": t.count_characters(F.col("text"))})
