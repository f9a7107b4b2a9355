"""Inputs derived from the driver's tables by formulas that both engines evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WIDTH, HEIGHT = 612.0, 792.0
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hyphen_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a hyphen and a line's end inside words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.withColumn("text", F.regexp_replace("text", r"([\p{L}]{3})([\p{L}]{3})", "$1-\n$2"))


HYPHEN_DOCS = r"""hyphen_docs AS (SELECT doc_id, lang, regexp_replace(text, '([\p{L}]{3})([\p{L}]{3})', '\1-' || chr(10) || '\2', 'g') AS text FROM documents)"""


def special_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with one of four special spaces for each space and a soft hyphen after each e."""
    kind = F.element_at(F.array(*(F.lit(c) for c in "\u00a0\u2009\u2002\u200a")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"))
    return docs.withColumn("text", F.replace(F.replace("original", F.lit(" "), kind), F.lit("e"), F.lit("e\u00ad")))


SPECIAL_DOCS = """special_docs AS (SELECT doc_id, text AS original, replace(replace(text, ' ', [chr(160), chr(8201), chr(8194), chr(8202)][CAST(doc_id % 4 + 1 AS INT)]), 'e', 'e' || chr(173)) AS text FROM documents)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of five orders each: kinds by position 0 table, 1 image, 2 text, 3 and 4 drawing."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER).withColumn("page_num", F.expr("l_orderkey div 5"))
    n = F.row_number().over(Window.partitionBy("page_num").orderBy(*ORDER)) - 1
    small = F.col("l_partkey") % 11 == 0
    out = lines.withColumn("item_idx", n).withColumns({
        "x0": ((F.col("l_partkey") * 37) % 13 * 45).cast("double"), "y0": ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 17) % 16 * 48).cast("double")})
    out = out.withColumns({
        "x1": F.col("x0") + F.when(small, 5).otherwise(40 + F.col("l_partkey") % 5 * 12), "y1": F.col("y0") + F.when(small, 4).otherwise(20 + F.col("l_suppkey") % 4 * 30),
        "kind": F.col("item_idx") % 5})
    return out.select(F.lit(0).cast("long").alias("doc_id"), "page_num", F.col("item_idx").cast("long").alias("idx"), "x0", "y0", "x1", "y1", "kind", "l_partkey", "l_suppkey")


BOXES = """boxes AS MATERIALIZED (
  SELECT page_num, idx, x0, y0, x0 + CASE WHEN l_partkey % 11 = 0 THEN 5 ELSE 40 + l_partkey % 5 * 12 END AS x1, y0 + CASE WHEN l_partkey % 11 = 0 THEN 4 ELSE 20 + l_suppkey % 4 * 30 END AS y1,
    idx % 5 AS kind, l_partkey, l_suppkey
  FROM (SELECT l_orderkey // 5 AS page_num, row_number() OVER (PARTITION BY l_orderkey // 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx,
      CAST((l_partkey * 37) % 13 * 45 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 17) % 16 * 48 AS DOUBLE) AS y0, l_partkey, l_suppkey FROM lineitem))"""


def of_kind(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    return boxes(spark, sf_dir).where(F.col("kind").isin(*kinds))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' sizes."""
    return boxes(spark, sf_dir).select("doc_id", "page_num").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def images(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    side = lambda a, b: ((F.col(b) - F.col(a)) / 72 * 96).cast("long")
    return of_kind(spark, sf_dir, *(kinds or (1,))).select("doc_id", "page_num", F.col("idx").alias("img_idx"), "x0", "y0", "x1", "y1", side("x0", "x1").alias("px_width"), side("y0", "y1").alias("px_height"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes as text blocks."""
    text = F.format_string("word%d-\ntext %d", (F.col("l_partkey") % 97), F.col("l_suppkey") % 13)
    return boxes(spark, sf_dir).select("doc_id", "page_num", F.col("idx").alias("block_idx"), "x0", "y0", "x1", "y1", F.when(F.col("l_partkey") % 17 == 0, " ").otherwise(text).alias("text"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


BLOCKS = f"""blocks AS (SELECT page_num, idx, x0, y0, x1, y1, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'word' || (l_partkey % 97) || '-' || chr(10) || 'text ' || (l_suppkey % 13) END AS text FROM boxes)"""


def _cells(v: str) -> tuple[str, ...]:
    """Cells of a grid's row in SQL that both engines read; v: the value expression's cast."""
    return (
        "CASE WHEN idx = 0 AND page_num % 3 = 0 THEN '' WHEN idx = 0 AND page_num % 3 = 1 THEN 'Name' WHEN idx = 0 THEN 'Title ' || page_num WHEN idx = 1 AND page_num % 3 = 2 THEN 'Key' WHEN l_partkey % 13 = 0 THEN ' none ' ELSE 'row' || (l_partkey % 50) END",
        "CASE WHEN idx = 0 AND page_num % 3 < 2 THEN 'Size' WHEN idx = 0 THEN NULL WHEN idx = 1 AND page_num % 3 = 2 THEN 'Size' WHEN l_partkey % 7 = 0 THEN NULL ELSE 's' || (l_suppkey % 9) END",
        "CASE WHEN idx = 0 AND page_num % 3 < 2 THEN CASE WHEN page_num % 2 = 0 THEN 'Size' ELSE NULL END WHEN idx = 0 THEN '' WHEN idx = 1 AND page_num % 3 = 2 THEN 'Size' WHEN l_partkey % 5 = 0 THEN '-' ELSE ' v' || (l_partkey % 31) || ' ' END",
        "CASE WHEN idx = 0 AND page_num % 3 < 2 THEN 'Note' WHEN idx = 0 THEN 'none' WHEN idx = 1 AND page_num % 3 = 2 THEN 'Size' WHEN l_suppkey % 3 = 0 THEN 'null' ELSE 'n' || (l_suppkey % 11) END",
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table grid for each page, with headlines, empty corners, repeated and blank headers, and placeholders."""
    rows = boxes(spark, sf_dir).select("doc_id", "page_num", "idx", F.array(*(F.expr(c) for c in _cells("string"))).alias("r"))
    return rows.groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r"))), lambda x: x["r"]).alias("cells"))


GRIDS = "grids AS (SELECT page_num, list([" + ", ".join(_cells("")) + "] ORDER BY idx) AS cells FROM boxes GROUP BY page_num)"
