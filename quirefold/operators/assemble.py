"""Chunks of pages, roll-ups of counters, and the assembly of pages into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.config import CHUNK_PAGES, WHOLE_BELOW, LayoutConfig
from quirefold.functions import text as t

#: Counters that a document keeps of its pages.
SUMMED = ("images_saved", "drawings_saved", "hyphens_fixed", "table_hyphens_fixed", "tables_skipped", "word_count", "char_count")


def chunks(files: DataFrame) -> DataFrame:
    """``files(.., page_count)`` -> a row for each range of pages, ``first_page`` and ``last_page``."""
    n = F.col("page_count")
    cut = F.transform(F.sequence(F.lit(1), n, F.lit(CHUNK_PAGES)), lambda s: F.struct(s.alias("first_page"), F.least(s + CHUNK_PAGES - 1, n).alias("last_page")))
    ranges = F.when(n < WHOLE_BELOW, F.array(F.struct(F.lit(1).alias("first_page"), n.cast("int").alias("last_page")))).otherwise(cut)
    return files.withColumn("__r", F.explode(ranges)).withColumns({"first_page": F.col("__r.first_page"), "last_page": F.col("__r.last_page")}).drop("__r")


def page_counters(parts: DataFrame, *names: str) -> DataFrame:
    """Counters of a page from those of its parts; a counter of 0 becomes null, as it is not recorded."""
    return parts.groupBy("doc_id", "page_num").agg(*(F.nullif(F.sum(c), F.lit(0)).alias(c) for c in names))


def file_rollup(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_num, error, pages_processed, pages_failed, <counters>)`` -> counters of each document; failed pages add to errors only."""
    good = F.col("error").isNull()
    count = lambda c, default: F.sum(F.when(good, F.coalesce(c, F.lit(default))).otherwise(0)).cast("long").alias(c)
    return pages.groupBy("doc_id").agg(
        count("pages_processed", 1), *(count(c, 0) for c in SUMMED),
        F.sum(F.when(~good, F.coalesce("pages_failed", F.lit(1))).otherwise(0)).cast("long").alias("errors"))


def global_rollup(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files_processed"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("pages_processed", *SUMMED, "errors")))


def isolate_errors(pages: DataFrame, whole_chunk: bool = False) -> DataFrame:
    """Page results with a ``chunk``: by default a failed page loses itself only; on request one error row stands for its whole chunk."""
    if not whole_chunk:
        return pages
    part = Window.partitionBy("doc_id", "chunk")
    failed = F.max(F.when(F.col("error").isNotNull(), 1).otherwise(0)).over(part) == 1
    first = F.min("page_num").over(part)
    marked = pages.withColumns({"__failed": failed, "__first": first, "__error": F.max("error").over(part), "__pages": F.count(F.lit(1)).over(part)})
    kept = marked.where(~F.col("__failed") | (F.col("page_num") == F.col("__first")))
    return kept.withColumns({
        "error": F.when(F.col("__failed"), F.col("__error")), "content": F.when(F.col("__failed"), F.lit("")).otherwise(F.col("content")),
        "pages_failed": F.when(F.col("__failed"), F.col("__pages")).otherwise(F.lit(0)),
    }).drop("__failed", "__first", "__error", "__pages")


def image_summary(judged: DataFrame) -> DataFrame:
    """Per page: how many images were found, saved and skipped (for whatever reason), and the saved ones' list."""
    item = F.struct(F.col("img_idx").alias("index"), F.col("px_width").alias("width"), F.col("px_height").alias("height"), "saved", "filename", F.col("reason").alias("skipped_reason"))
    return judged.groupBy("doc_id", "page_num").agg(
        F.count(F.lit(1)).alias("image_count"), F.count_if("saved").alias("images_saved"), F.count_if(~F.col("saved")).alias("images_skipped_small"),
        F.array_sort(F.collect_list(F.when(F.col("saved"), item))).alias("images_with_resolution"))


def drawing_summary(judged: DataFrame) -> DataFrame:
    """Per page: all kept drawings with their state; those that were not saved count as failed."""
    item = F.struct((F.col("number") - 1).alias("index"), "resolution", "saved", "filename", "skipped_reason")
    return judged.groupBy("doc_id", "page_num").agg(
        F.count(F.lit(1)).alias("drawing_count"), F.count_if("saved").alias("drawings_saved"), F.count_if(~F.col("saved")).alias("drawings_failed"),
        F.array_sort(F.collect_list(item)).alias("drawings_with_resolution"))


def media_section(summary: DataFrame, pages: DataFrame, kind: str, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``(doc_id, page_num, section)`` for every page; pages without any say so."""
    names = [c for c in summary.columns if c not in ("doc_id", "page_num")]
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    count = names[0]
    full = F.concat(F.format_string(f"\n\n{kind.upper()}S FOUND ON PAGE %d: %d\n\n```json\n", "page_num", count), record, F.lit("\n```\n\n"))
    none = F.format_string("Image extraction disabled on page %d.\n\n" if kind == "image" and not config.save_images else f"No {kind}s detected on page %d.\n\n", "page_num")
    return pages.select("doc_id", "page_num").join(summary, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.when(F.col(count).isNotNull(), full).otherwise(none).alias("section"))


def pages_of(fragments: DataFrame) -> DataFrame:
    """``fragments(doc_id, page_num, kind, position, section)`` -> ``content``: tables, text, images, drawings in that order."""
    order = F.when(F.col("kind") == "table", 1).when(F.col("kind") == "text", 2).when(F.col("kind") == "image", 3).otherwise(4)
    joined = fragments.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "position", "section"))).alias("__f"))
    label = F.format_string("--- Page %d ---\n\n", "page_num")
    return joined.select("doc_id", "page_num", F.concat(label, F.array_join(F.transform("__f", lambda x: x["section"]), "")).alias("content"))


def header(name: Column, media: Column, config: LayoutConfig | None = None) -> Column:
    """The head of a document's text: a fixed format."""
    state = [] if config is None else [F.lit(f"Hyphen Fix: {'enabled' if config.hyphen_fix else 'disabled'}\n")]
    return F.concat(
        F.format_string("PDF: %s\nMedia Directory: %s\n", name, media), *state,
        F.format_string("Word Count: %d\nCharacter Count: %d\nText Hyphens Fixed: %d\nTable Hyphens Fixed: %d\n", "word_count", "char_count", "hyphens_fixed", "table_hyphens_fixed"),
        F.lit("=" * 60 + "\n\n"))


def documents(pages: DataFrame, files: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``pages(doc_id, page_num, content, error, <counters>)``, ``files(doc_id, filename, metadata)`` -> ``(doc_id, filename, text, <counters>)``."""
    texts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "content"))).alias("__p"))
    whole = files.join(file_rollup(pages), "doc_id").join(texts, "doc_id")
    clean = t.clean_metadata(F.col("metadata"))
    meta = F.when(F.lit(config.include_metadata) & (F.coalesce(F.size(clean), F.lit(0)) > 0), F.concat(F.lit("PDF METADATA\n\n```json\n"), F.to_json(clean), F.lit("\n```\n\n"))).otherwise("")
    body = F.array_join(F.transform("__p", lambda x: x["content"]), "")
    text = F.concat(header(F.col("filename"), F.concat("filename", F.lit("_media")), config), meta, body)
    return whole.withColumn("text", text).drop("__p", "metadata")
