"""Files in and out: texts, images, page geometry, and one file for each assembled document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirefold.functions import text as t

#: Extensions that count as images: fixed values.
IMAGE_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "webp")


def listed(spark: SparkSession, folder: str, *extensions: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """``(path, content)`` of files by extension in any case; names that start with a dot or underscore are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]))
    return kept.select("path", *(["content"] if content else ["length"]))


def new_paths(found: DataFrame, known: DataFrame) -> DataFrame:
    """Each path once, without those known already."""
    return found.dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of the ``.txt`` files directly in a folder."""
    whole = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return whole.where(F.lower("path").endswith(".txt"))


def images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    return listed(spark, folder, *IMAGE_EXTENSIONS, recursive=recursive).withColumn("image", t.base_name(F.col("path")))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``(folder, base, text)`` of description files."""
    return texts(spark, folder).select(t.folder(F.col("path")).alias("folder"), t.stem(F.col("path")).alias("base"), "text")


def _open(content: bytes):
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pymupdf") from e
    return pymupdf.open(stream=content, filetype="pdf")


VALIDATED = "path string, filename string, valid boolean, page_count int, reason string, is_repaired boolean, is_protected boolean, metadata map<string,string>"


def validated(files: DataFrame, opener=_open) -> DataFrame:
    """``files(path, content)`` -> a record of each; what cannot be opened is a row with a reason, not an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                row = {"path": path, "filename": PurePosixPath(path).stem, "valid": False, "page_count": None, "reason": None, "is_repaired": False, "is_protected": False, "metadata": {}}
                try:
                    with opener(bytes(content)) as document:
                        row["is_repaired"], row["is_protected"] = bool(getattr(document, "is_repaired", False)), bool(getattr(document, "needs_pass", False))
                        if row["is_protected"]:
                            row["reason"] = "Password protected"
                        else:
                            row |= {"valid": True, "page_count": len(document), "metadata": {str(k): str(v) for k, v in (document.metadata or {}).items() if v not in (None, "")}}
                except Exception as e:  # any unreadable file is a record with its reason
                    row["reason"] = str(e)
                rows.append(row)
            frame = pd.DataFrame(rows)
            frame["page_count"] = frame["page_count"].astype("Int32") if len(frame) else frame.get("page_count")
            yield frame

    return files.select("path", "content").mapInPandas(run, VALIDATED)


_PAGE = "doc_id string, page_num int, "
_BOX = "x0 double, y0 double, x1 double, y1 double"
_FOUR = tuple[float, float, float, float]


def _four(box) -> _FOUR:
    return tuple(float(v) for v in (box if isinstance(box, (tuple, list)) else (box.x0, box.y0, box.x1, box.y1)))


def scan_pages(files: DataFrame, columns: str, read: Callable[[object], list[tuple]], opener=_open) -> DataFrame:
    """``files(path, content, first_page, last_page)`` -> the rows that ``read(page)`` finds on each page.

    A page that cannot be read is one row of nulls beside its number, and a file that cannot be opened one such row
    for its first page: errors are data, and other pages and files stay.
    """
    schema = _PAGE + columns + ", error string"
    names = [c.strip().split()[0] for c in schema.replace("array<array<string>>", "x").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, first, last in zip(batch["path"], batch["content"], batch["first_page"], batch["last_page"]):
                missing = [None] * (len(names) - 3)
                try:
                    with opener(bytes(content)) as document:
                        for n in range(int(first), int(last) + 1):
                            try:
                                rows += [(path, n, *found, None) for found in read(document[n - 1])]
                            except Exception as e:
                                rows.append((path, n, *missing, str(e)))
                except Exception as e:
                    rows.append((path, int(first), *missing, str(e)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content", "first_page", "last_page").mapInPandas(run, schema)


def blocks(files: DataFrame, opener=_open) -> DataFrame:
    """Text blocks with the page's size."""

    def read(page) -> list[tuple]:
        size = float(page.rect.width), float(page.rect.height)
        return [(k, *_four(b[:4]), b[4], *size) for k, b in enumerate(page.get_text("blocks"))]

    return scan_pages(files, f"block_idx int, {_BOX}, text string, width double, height double", read, opener)


def images_on_pages(files: DataFrame, opener=_open) -> DataFrame:
    """Images placed on pages, with their size in pixels."""

    def read(page) -> list[tuple]:
        return [(k, int(i.get("xref", 0)), *_four(i["bbox"]), int(i["width"]), int(i["height"])) for k, i in enumerate(page.get_image_info(xrefs=True))]

    return scan_pages(files, f"img_idx int, xref int, {_BOX}, px_width int, px_height int", read, opener)


def drawings_on_pages(files: DataFrame, opener=_open) -> DataFrame:
    """Vector drawings, with the kinds of their items joined by commas."""

    def read(page) -> list[tuple]:
        return [(k, *_four(d["rect"]), ",".join(str(i[0]) for i in d.get("items", ()))) for k, d in enumerate(page.get_drawings())]

    return scan_pages(files, f"idx int, {_BOX}, kinds string", read, opener)


def drawing_clusters_on_pages(files: DataFrame, opener=_open) -> DataFrame:
    """Groups of drawings as the reader clusters them."""
    return scan_pages(files, f"idx int, {_BOX}", lambda page: [(k, *_four(b)) for k, b in enumerate(page.cluster_drawings() or ())], opener)


def tables_on_pages(files: DataFrame, opener=_open) -> DataFrame:
    """Detected table grids; pages without a line or rectangle are not searched, as the search is dear."""

    def read(page) -> list[tuple]:
        if not any(i[0] in ("l", "re") for d in page.get_drawings() for i in d.get("items", ())):
            return []
        return [(k + 1, *_four(t.bbox), [[None if c is None else str(c) for c in row] for row in t.extract()]) for k, t in enumerate(page.find_tables())]

    return scan_pages(files, f"table_num int, {_BOX}, cells array<array<string>>", read, opener)


def saved_media(items: DataFrame, render: Callable[[dict], None]) -> DataFrame:
    """``items`` with ``saved`` and ``save_error``: ``render(row)`` writes one picture; what fails is a state, not an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.to_dict("records"):
                try:
                    render(row)
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e))
            yield batch.assign(saved=[e is None for e in errors], save_error=errors)

    kept = items.drop("saved", "save_error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, saved boolean, save_error string")


def changed_only(outputs: DataFrame, before: DataFrame) -> DataFrame:
    """Texts that differ from what is there, or are new: the only ones worth writing again."""
    old = before.select("path", F.col("text").alias("__old"))
    return outputs.join(old, "path", "left").where(~F.col("text").eqNullSafe(F.col("__old"))).drop("__old")


def write_documents(docs: DataFrame, folder: str) -> None:
    """Texts of ``docs(filename, text)`` as one file for each name, through Spark's own writer: ``folder/filename=.../part``.

    Any file system that Spark reaches will do, and a lost task is written again; nothing in the folder is deleted
    but the documents written now.  Every file ends with a line's end, which is added where it is missing.
    """
    rows = docs.select("filename", F.regexp_replace("text", r"\n\z", "").alias("value")).repartition("filename")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filename").text(folder)
