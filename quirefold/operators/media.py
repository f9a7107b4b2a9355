"""Images and vector drawings of pages: filters in order, limits, overlap joins, clusters and conflicts.

``images(doc_id, page_num, img_idx, xref, x0..y1, px_width, px_height)``, ``drawings(doc_id, page_num, idx, x0..y1)``,
``reference(doc_id, page_num, kind, x0..y1)`` with kind in tables, images, text_blocks, ``pages(doc_id, page_num, width, height)``.
Joins are on the page first, with geometry as a further condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.config import CONFLICT_OVERLAP, FULL_PAGE, SIMILAR_OVERLAP, TEXT_OVERLAP, LayoutConfig
from quirefold.functions import geometry as g, text as t

PAGE = ["doc_id", "page_num"]


def _boxed(df: DataFrame, suffix: str, *more: str) -> DataFrame:
    return df.select(*PAGE, *(F.col(c).alias(f"{c}{suffix}") for c in ("x0", "y0", "x1", "y1", *more)))


def pairs_within(left: DataFrame, right: DataFrame, key: str, condition) -> DataFrame:
    """Pairs of a page's boxes, left ``key`` below right ``key``, for which ``condition(left box, right box)`` holds."""
    joined = _boxed(left, "_a", key).join(_boxed(right, "_b", key), PAGE)
    return joined.where((F.col(f"{key}_a") < F.col(f"{key}_b")) & condition(g.box(suffix="_a"), g.box(suffix="_b")))


def over_text(images: DataFrame, text: DataFrame) -> DataFrame:
    """The images that nearly coincide with a text block of similar size."""
    rule = lambda a, b: g.similar(a, b, least=TEXT_OVERLAP)
    other = _boxed(text, "_t")
    condition = [images[c] == other[c] for c in PAGE] + [rule(g.Box(*(images[c] for c in ("x0", "y0", "x1", "y1"))), g.box(suffix="_t"))]
    return images.join(other, condition, "left_semi")


def judge_images(images: DataFrame, text: DataFrame, pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``images`` with ``reason`` (null: saved) by the first rule that applies, ``saved`` and ``filename``."""
    b, w, h = g.box(), F.col("width"), F.col("height")
    hidden = over_text(images, text).select(*PAGE, "img_idx", F.lit(True).alias("over_text"))
    sized = images.join(pages, PAGE).join(hidden, [*PAGE, "img_idx"], "left")
    first = (
        F.when(F.least("px_width", "px_height") < config.min_size_px, f"below {config.min_size_px}px threshold")
        .when(g.covers_page(b, w, h, FULL_PAGE), F.format_string("full-page image (%.0fx%.0fpts vs page %.0fx%.0fpts)", F.rint(b.width), F.rint(b.height), F.rint(w), F.rint(h)))
        .when(g.center_in_margin(b, w, h, config), "Content lies on outer margin")
        .when(F.coalesce("over_text", F.lit(False)), "overlaps >90% with similar-size text block")
    )
    rest = Window.partitionBy(*PAGE).orderBy("img_idx").rowsBetween(Window.unboundedPreceding, -1)
    judged = sized.withColumn("reason", first).withColumn("__before", F.coalesce(F.count_if(F.col("reason").isNull()).over(rest), F.lit(0)))
    limit = F.lit(config.max_items_per_page > 0) & (F.col("__before") >= config.max_items_per_page)
    last = F.when(F.col("reason").isNull() & limit, "max limit reached").when(F.col("reason").isNull() & F.lit(not config.save_images), "save_images=False").otherwise(F.col("reason"))
    name = g.media_name(F.col("doc_id").cast("string"), F.col("page_num").cast("int"), "img", (F.col("img_idx") + 1).cast("int"))
    return judged.withColumn("reason", last).withColumn("saved", F.col("reason").isNull()).withColumn("filename", F.when(F.col("saved"), name)).drop("__before", "over_text", "width", "height")


def first_per_page(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each page."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*PAGE).orderBy(order))).where(F.col("__k") <= limit).drop("__k")


def small_text(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Short European texts that may belong to a drawing."""
    text = F.col("text")
    return blocks.where((F.coalesce(text, F.lit("")) != "") & (t.count_visible(text) <= config.small_text_max_chars) & t.is_european(text) & g.large_enough(g.box(), config.min_block_size_px))


def nearby(items: DataFrame, tolerance: float) -> DataFrame:
    """Edges ``(doc_id, page_num, idx_a, idx_b)`` between boxes of a page at most ``tolerance`` apart.

    Left edges fall into strips; a box meets those of the strips it reaches, so that crowded pages make no full product.
    """
    strip = max(tolerance, 1.0) * 4
    left = _boxed(items, "_a", "idx").withColumn("__s", F.explode(F.sequence(F.floor(F.col("x0_a") / strip), F.floor((F.col("x1_a") + tolerance) / strip))))
    right = _boxed(items, "_b", "idx").withColumn("__s", F.floor(F.col("x0_b") / strip))
    first = (F.col("x0_a") < F.col("x0_b")) | ((F.col("x0_a") == F.col("x0_b")) & (F.col("idx_a") < F.col("idx_b")))
    close = left.join(right, [*PAGE, "__s"]).where(first & (F.col("x0_b") <= F.col("x1_a") + tolerance) & (g.distance(g.box(suffix="_a"), g.box(suffix="_b")) <= tolerance))
    return close.select(*PAGE, F.least("idx_a", "idx_b").alias("idx_a"), F.greatest("idx_a", "idx_b").alias("idx_b"))


def _solved(pages: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    """Smallest member of each edge's tree, for whole pages; ``group`` numbers the pages of the rows."""
    ends = np.concatenate([np.stack([group, pages[c].to_numpy()], axis=1) for c in ("idx_a", "idx_b")])
    nodes, place = np.unique(ends, axis=0, return_inverse=True)  # in order of page and idx
    low, place = list(range(len(nodes))), place.ravel().tolist()

    def find(k: int) -> int:
        while low[k] != k:
            low[k] = k = low[low[k]]
        return k

    for a, b in zip(place[: len(pages)], place[len(pages) :]):
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    root = np.array([find(k) for k in range(len(nodes))])
    first = np.searchsorted(group, nodes[:, 0])
    return pd.DataFrame({"doc_id": pages["doc_id"].to_numpy()[first], "page_num": pages["page_num"].to_numpy()[first], "idx": nodes[:, 1], "component": nodes[root, 1]})


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a page stand together, and a page may span batches: the last one of a batch waits for the next."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        change = (batch["doc_id"].ne(batch["doc_id"].shift()) | batch["page_num"].ne(batch["page_num"].shift())).to_numpy()
        last = int(np.flatnonzero(change)[-1])
        if last:
            yield _solved(batch.iloc[:last], np.cumsum(change[:last]))
        held = batch.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield _solved(held, np.ones(len(held), dtype=np.int64))


def clusters(items: DataFrame, tolerance: float) -> DataFrame:
    """``items(doc_id, page_num, idx, x0..y1)`` with ``component``: the smallest idx reachable by near neighbours."""
    edges = nearby(items, tolerance).repartition("doc_id", "page_num").sortWithinPartitions("doc_id", "page_num")
    kinds = dict(items.dtypes)
    found = edges.mapInPandas(_components, f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, idx {kinds['idx']}, component {kinds['idx']}")
    return items.join(found, [*PAGE, "idx"], "left").withColumn("component", F.coalesce("component", "idx"))


def cluster_boxes(items: DataFrame, tolerance: float) -> DataFrame:
    """One row for each cluster: its box, members and their number, in order of the smallest member."""
    grouped = clusters(items, tolerance).groupBy(*PAGE, "component").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("cluster_count"), F.array_sort(F.collect_list("idx")).alias("members"))
    return grouped.withColumn("position", F.row_number().over(Window.partitionBy(*PAGE).orderBy("component")))


def count_items(clustered: DataFrame, drawings: DataFrame, blocks: DataFrame | None, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``clustered(.., component, x0..y1)`` with the numbers of vector boxes and short texts wholly inside."""

    def inside(other: DataFrame, name: str) -> DataFrame:
        pairs = _boxed(clustered, "", "component").join(_boxed(other, "_i"), PAGE).where(g.contains(g.box(), g.box(suffix="_i")))
        return pairs.groupBy(*PAGE, "component").agg(F.count(F.lit(1)).alias(name))

    out = clustered.join(inside(drawings, "rectangles"), [*PAGE, "component"], "left")
    if blocks is not None and config.include_small_text:
        short = blocks.where((F.coalesce(F.col("text"), F.lit("")) != "") & (t.count_visible(F.col("text")) <= config.counted_text_max_chars))
        out = out.join(inside(short, "texts"), [*PAGE, "component"], "left")
    else:
        out = out.withColumn("texts", F.lit(0).cast("long"))
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rectangles", "texts")})


def precedence(drawings: DataFrame, reference: DataFrame, key: str = "idx") -> DataFrame:
    """``drawings`` with ``blocked_by``: the first kind of reference box that takes precedence, else null.

    Tables win if the drawing's center lies in one or the overlap is high; images and texts if they nearly coincide.
    """
    a, b = g.box(), g.box(suffix="_r")
    table = (F.col("kind") == "tables") & g.overlaps(a, b) & (g.center_inside(b, a) | (g.iou(a, b) >= SIMILAR_OVERLAP))
    other = F.col("kind").isin("images", "text_blocks") & g.similar(a, b)
    pairs = _boxed(drawings, "", key).join(_boxed(reference.withColumnRenamed("kind", "k"), "_r", "k").withColumnRenamed("k_r", "kind"), PAGE).where(table | other)
    order = F.when(F.col("kind") == "tables", 1).when(F.col("kind") == "images", 2).otherwise(3)
    first = pairs.groupBy(*PAGE, key).agg(F.min_by("kind", order).alias("blocked_by"))
    return drawings.join(first, [*PAGE, key], "left")


def judge_drawings(clustered: DataFrame, drawings: DataFrame, blocks: DataFrame | None, reference: DataFrame, pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Clusters with ``skip`` (null: kept): margin, min_items, size, overlap or limit, whichever comes first; kept ones are numbered and named."""
    counted = precedence(count_items(clustered, drawings, blocks, config), reference, "component").join(pages, PAGE)
    b = g.box()
    w, h = g.pixels(b.width), g.pixels(b.height)
    small = F.lit(config.min_size_px > 0) & ((F.greatest(w, h) < config.min_size_px) | (F.least(w, h) < config.min_size_px / 4))
    skip = (
        F.when(g.center_in_margin(b, F.col("width"), F.col("height"), config), "margin")
        .when(F.col("rectangles") < config.min_items_per_cluster, "min_items")
        .when(small, "size")
        .when(F.col("blocked_by").isNotNull(), "overlap")
    )
    before = Window.partitionBy(*PAGE).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    judged = counted.withColumn("skip", skip).withColumn("number", F.coalesce(F.count_if(F.col("skip").isNull()).over(before), F.lit(0)) + 1)
    over = F.lit(config.max_items_per_page > 0) & (F.col("number") > config.max_items_per_page)
    judged = judged.withColumn("skip", F.when(F.col("skip").isNull() & over, "limit").otherwise(F.col("skip")))
    name = g.media_name(F.col("doc_id").cast("string"), F.col("page_num").cast("int"), "drawing", F.col("number").cast("int"))
    kept = F.col("skip").isNull()
    return judged.withColumn("filename", F.when(kept, name)).withColumn("number", F.when(kept, F.col("number"))).withColumn("resolution", F.array(w.cast("int"), h.cast("int"))).drop("width", "height")


def resolve_conflicts(images: DataFrame, drawings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an image and a drawing that mostly coincide the larger stays; both lists with ``lost_to`` (null: kept) and ``share``.

    In the order of drawings an image falls to the first larger drawing; a drawing falls to a larger image that
    no earlier drawing removed, the last such one being named.
    """
    pairs = _boxed(images, "_i", "img_idx").join(_boxed(drawings, "_d", "idx"), PAGE)
    i, d = g.box(suffix="_i"), g.box(suffix="_d")
    pairs = pairs.where(g.overlaps(i, d) & (g.smaller_share(i, d) > CONFLICT_OVERLAP)).select(
        *PAGE, F.col("img_idx_i").alias("img_idx"), F.col("idx_d").alias("idx"), g.smaller_share(i, d).alias("share"), (i.area - d.area).alias("more"))
    killed = pairs.where("more < 0").groupBy(*PAGE, "img_idx").agg(F.min("idx").alias("lost_to"), F.min_by("share", "idx").alias("share"))
    falls = pairs.where("more > 0").join(killed.select(*PAGE, "img_idx", "lost_to"), [*PAGE, "img_idx"], "left").where("lost_to is null or lost_to > idx")
    lost = falls.groupBy(*PAGE, "idx").agg(F.max("img_idx").alias("lost_to"), F.max_by("share", "img_idx").alias("share"))
    return images.join(killed, [*PAGE, "img_idx"], "left"), drawings.join(lost, [*PAGE, "idx"], "left")


def conflict_reason(share: Column, other: str) -> Column:
    """The share with one decimal, ties to even."""
    return F.format_string(f"Overlap with larger {other} (%.1f%% coverage)", F.bround(share * 100, 1))
