"""Registered queries of the layout operators, each beside SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quirefold.config import LayoutConfig
from quirefold.functions import geometry as g, text as t
from quirefold.operators import assemble, describe, enrich, layout, media, progress, tables
from quirefold.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WS = t.SPACES.replace("\\x", "\\x")
_INLINE = t.INLINE
_TWO = LayoutConfig(max_items_per_page=2)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _lines_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda z: {_strip_sql('z')}), chr(10))"


def _fix_sql(x: str) -> str:
    return f"replace(regexp_replace({_lines_sql(x)}, '([^\\n]*?)[{_INLINE}]*-\\n([^\\n]+)', '\\1\\2', 'g'), chr(10), ' ')"


def _joins_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({_lines_sql(x)}, '[^\\n]*-\\n[^\\n]+')) AS BIGINT)"


def _words_sql(x: str) -> str:
    word = t.WORD.replace("'", "''")
    return f"CAST(len(regexp_extract_all({x}, '{word}')) AS BIGINT)"


def _clean_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '[\\r\\n]+', ' ', 'g'), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    return _strip_sql(f"regexp_replace(replace({x}, chr(9), ' '), ' +', ' ', 'g')")


# Texts -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.HYPHEN_DOCS}, fixed AS (SELECT lang, {_fix_sql('text')} AS text, {_joins_sql('text')} AS n FROM hyphen_docs)
SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS hyphens_fixed, CAST(sum({_words_sql('text')}) AS BIGINT) AS word_count, CAST(sum(len(text)) AS BIGINT) AS char_count FROM fixed GROUP BY lang""")
def doc_text_stats(spark, sf_dir):
    docs = fx.hyphen_docs(spark, sf_dir).withColumn("text", t.normalise_spaces(F.col("text")))
    fixed = docs.select("lang", t.count_hyphens(F.col("text")).alias("n"), t.fix_hyphens(F.col("text")).alias("text"))
    return fixed.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("hyphens_fixed"), F.sum(t.count_words(F.col("text"))).alias("word_count"), F.sum(t.count_characters(F.col("text"))).alias("char_count"))


@query(f"""WITH {fx.SPECIAL_DOCS}, c AS (SELECT doc_id, original, translate(text, chr(8201) || chr(160) || chr(8194) || chr(8202) || chr(173) || chr(8203), '    ') AS text FROM special_docs)
SELECT doc_id, md5(text) AS digest, text = original AS restored FROM c""")
def normalise_spaces(spark, sf_dir):
    clean = fx.special_docs(spark, sf_dir).withColumn("text", t.normalise_spaces(F.col("text")))
    return clean.select("doc_id", F.md5("text").alias("digest"), (F.col("text") == F.col("original")).alias("restored"))


@query(f"WITH {fx.HYPHEN_DOCS} SELECT doc_id, {_joins_sql('text')} AS hyphens_fixed, md5({_fix_sql('text')}) AS digest FROM hyphen_docs")
def hyphen_fix(spark, sf_dir):
    return fx.hyphen_docs(spark, sf_dir).select("doc_id", t.count_hyphens(F.col("text")).alias("hyphens_fixed"), F.md5(t.fix_hyphens(F.col("text"))).alias("digest"))


_CELL = "concat(' ', coalesce(text, ''), chr(9), 'x-', chr(10), 'y', chr(1), chr(13), chr(10), '  z ')"


@query(f"SELECT doc_id, [{_clean_sql(_fix_sql(_CELL))}, {_clean_sql(_fix_sql('lang'))}] AS cells, {_joins_sql(_CELL)} AS fixes FROM documents")
def clean_cells(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.array(F.array(F.expr(_CELL), "lang")).alias("cells"))
    return docs.select("doc_id", F.get(tables.clean_cells(F.col("cells")), F.lit(0)).alias("cells"), tables.count_fixes(F.col("cells")).alias("fixes"))


@query(f"SELECT doc_id, {_words_sql('text')} AS words, CAST(len(text) AS BIGINT) AS characters, CAST(len(regexp_replace(text, '[{_WS}]', '', 'g')) AS BIGINT) AS visible FROM documents")
def word_char_counts(spark, sf_dir):
    c = F.col("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.count_words(c).alias("words"), t.count_characters(c).alias("characters"), t.count_visible(c).alias("visible"))


@query(f"SELECT doc_id, CASE WHEN len(text) > 0 THEN round((len(text) - len(regexp_replace(text, '[{t.EUROPEAN}]', '', 'g'))) / len(text), 6) ELSE 0 END AS ratio, CASE WHEN len(text) > 0 THEN (len(text) - len(regexp_replace(text, '[{t.EUROPEAN}]', '', 'g'))) / len(text) > 0.5 ELSE false END AS european FROM documents")
def european_ratio(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.round(t.european_ratio(F.col("text")), 6).alias("ratio"), t.is_european(F.col("text")).alias("european"))


# Boxes -------------------------------------------------------------------------------------------------------------

_B = f"WITH {fx.BOXES}"
_PX = "trunc(({0}) / 72 * 96)"
_LARGE = f"({_PX.format('x1 - x0')} >= 10 OR {_PX.format('y1 - y0')} >= 10)"
_CENTER = "NOT ((x0 + x1) / 2 BETWEEN 612 * 0.05::DOUBLE AND 612 * 0.95::DOUBLE AND (y0 + y1) / 2 BETWEEN 792 * 0.05::DOUBLE AND 792 * 0.95::DOUBLE)"
_STRICT = "NOT (x0 >= 612 * 0.05::DOUBLE AND x1 <= 612 * 0.95::DOUBLE AND y0 >= 792 * 0.05::DOUBLE AND y1 <= 792 * 0.95::DOUBLE)"
_C = LayoutConfig()


def _sql_overlap(a: str, b: str) -> str:
    return f"{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


def _sql_inter(a: str, b: str) -> str:
    return f"((least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def _sql_area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _sql_iou(a: str, b: str) -> str:
    return f"({_sql_inter(a, b)} / nullif({_sql_area(a)} + {_sql_area(b)} - {_sql_inter(a, b)}, 0))"


def _sql_similar(a: str, b: str, least: float = 0.8) -> str:
    return f"({_sql_overlap(a, b)} AND {_sql_iou(a, b)} >= {least}::DOUBLE AND abs({_sql_area(a)} - {_sql_area(b)}) / nullif(greatest({_sql_area(a)}, {_sql_area(b)}), 0) <= 0.2::DOUBLE)"


@query(f"{_B} SELECT page_num, idx, {_LARGE} AS kept FROM boxes")
def size_filter(spark, sf_dir):
    return fx.boxes(spark, sf_dir).select("page_num", "idx", g.large_enough(g.box(), 10).alias("kept"))


@query(f"{_B} SELECT page_num, idx, {_CENTER} AS violates FROM boxes")
def margin_center(spark, sf_dir):
    return fx.boxes(spark, sf_dir).select("page_num", "idx", g.center_in_margin(g.box(), F.lit(fx.WIDTH), F.lit(fx.HEIGHT), _C).alias("violates"))


@query(f"{_B} SELECT page_num, idx, {_STRICT} AS violates FROM boxes")
def margin_strict(spark, sf_dir):
    return fx.boxes(spark, sf_dir).select("page_num", "idx", g.touches_margin(g.box(), F.lit(fx.WIDTH), F.lit(fx.HEIGHT), _C).alias("violates"))


@query(f"{_B} SELECT a.page_num, a.idx AS idx_a, b.idx AS idx_b, round({_sql_iou('a', 'b')}, 6) AS iou, {_sql_inter('a', 'b')} AS intersection FROM boxes a JOIN boxes b ON a.page_num = b.page_num AND a.idx < b.idx AND {_sql_overlap('a', 'b')}")
def iou_pairs(spark, sf_dir):
    b = fx.boxes(spark, sf_dir)
    pairs = media.pairs_within(b, b, "idx", g.overlaps)
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    return pairs.select("page_num", "idx_a", "idx_b", F.round(g.iou(a, b), 6).alias("iou"), g.intersection(a, b).alias("intersection"))


@query(f"{_B} SELECT a.page_num, a.idx AS idx_a, b.idx AS idx_b FROM boxes a JOIN boxes b ON a.page_num = b.page_num AND a.idx < b.idx AND {_sql_similar('a', 'b')}")
def high_overlap_pairs(spark, sf_dir):
    b = fx.boxes(spark, sf_dir)
    return media.pairs_within(b, b, "idx", g.similar).select("page_num", "idx_a", "idx_b")


_IMAGES = f"images AS (SELECT page_num, idx AS img_idx, x0, y0, x1, y1, {_PX.format('x1 - x0')} AS w, {_PX.format('y1 - y0')} AS h FROM boxes WHERE kind IN ({{0}}))"
_JUDGED = f"""first AS (SELECT *, CASE WHEN least(w, h) < {{0}} THEN 'below {{0}}px threshold'
  WHEN x1 - x0 >= 0.8::DOUBLE * 612 AND y1 - y0 >= 0.8::DOUBLE * 792 THEN 'full-page image' WHEN {_CENTER} THEN 'Content lies on outer margin'
  WHEN EXISTS (SELECT 1 FROM boxes t WHERE t.page_num = i.page_num AND t.kind = 2 AND {_sql_similar('i', 't', 0.9)}) THEN 'overlaps >90% with similar-size text block' END AS reason FROM images i),
judged AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY img_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM first)"""


def _judged(spark, sf_dir, config, *kinds):
    return media.judge_images(fx.images(spark, sf_dir, *kinds), fx.of_kind(spark, sf_dir, 2), fx.pages(spark, sf_dir), config)


@query(f"""{_B}, {_IMAGES.format('1')}, {_JUDGED.format(30)}
SELECT page_num, img_idx, coalesce(reason, CASE WHEN before >= 10 THEN 'max limit reached' END) AS reason, reason IS NULL AND before < 10 AS saved,
  CASE WHEN reason IS NULL AND before < 10 THEN printf('0_page_%04d_img_%02d.png', page_num, img_idx + 1) END AS filename FROM judged""")
def image_cascade(spark, sf_dir):
    return _judged(spark, sf_dir, LayoutConfig(min_size_px=30)).select("page_num", "img_idx", "reason", "saved", "filename")


@query(f"""{_B}, {_IMAGES.format('1, 3, 4')}, {_JUDGED.format(10)}
SELECT page_num, img_idx FROM judged WHERE reason IS NULL AND before < 2""")
def image_topk(spark, sf_dir):
    return _judged(spark, sf_dir, LayoutConfig(min_size_px=10, max_items_per_page=2), 1, 3, 4).where("saved").select("page_num", "img_idx")


@query(f"""{_B}, {_IMAGES.format('1')}, {_JUDGED.format(30)}
SELECT page_num, count(*) AS image_count, count(*) FILTER (reason IS NULL AND before < 10) AS images_saved, count(*) FILTER (NOT (reason IS NULL AND before < 10)) AS images_skipped_small,
  coalesce(list(img_idx ORDER BY img_idx) FILTER (reason IS NULL AND before < 10), []) AS saved FROM judged GROUP BY page_num""")
def image_page_summary(spark, sf_dir):
    out = assemble.image_summary(_judged(spark, sf_dir, LayoutConfig(min_size_px=30)))
    return out.select("page_num", "image_count", "images_saved", "images_skipped_small", F.transform("images_with_resolution", lambda x: x["index"]).alias("saved"))


_DISTANCE = """(SELECT CASE WHEN dx < 0 AND dy < 0 THEN least(dx, dy) ELSE sqrt(greatest(dx, 0) * greatest(dx, 0) + greatest(dy, 0) * greatest(dy, 0)) END
  FROM (SELECT greatest(b.x0 - a.x1, a.x0 - b.x1) AS dx, greatest(b.y0 - a.y1, a.y0 - b.y1) AS dy))"""
_NEAR = """items AS (SELECT * FROM boxes WHERE kind IN (3, 4)),
near AS (SELECT a.page_num, a.idx AS a, b.idx AS b FROM items a JOIN items b ON a.page_num = b.page_num AND (a.x0 < b.x0 OR a.x0 = b.x0 AND a.idx < b.idx) AND b.x0 <= a.x1 + 20
  AND CASE WHEN greatest(b.x0 - a.x1, a.x0 - b.x1) < 0 AND greatest(b.y0 - a.y1, a.y0 - b.y1) < 0 THEN true
    ELSE sqrt(greatest(b.x0 - a.x1, a.x0 - b.x1, 0) * greatest(b.x0 - a.x1, a.x0 - b.x1, 0) + greatest(b.y0 - a.y1, a.y0 - b.y1, 0) * greatest(b.y0 - a.y1, a.y0 - b.y1, 0)) <= 20 END)"""
_COMPONENTS = f"""{_NEAR}, edges AS (SELECT page_num, a, b FROM near UNION SELECT page_num, b, a FROM near),
reach(page_num, a, b) AS (SELECT page_num, idx, idx FROM items UNION SELECT r.page_num, r.a, e.b FROM reach r JOIN edges e ON e.page_num = r.page_num AND e.a = r.b),
component AS (SELECT page_num, a AS idx, min(b) AS component FROM reach GROUP BY page_num, a)"""
_R = f"WITH RECURSIVE {fx.BOXES}"


@query(f"{_B}, {_NEAR} SELECT page_num, least(a, b) AS idx_a, greatest(a, b) AS idx_b FROM near")
def near_pairs(spark, sf_dir):
    return media.nearby(fx.of_kind(spark, sf_dir, 3, 4), 20.0).select("page_num", "idx_a", "idx_b")


@query(f"{_R}, {_COMPONENTS} SELECT page_num, idx, component FROM component")
def cluster_components(spark, sf_dir):
    return media.clusters(fx.of_kind(spark, sf_dir, 3, 4), 20.0).select("page_num", "idx", "component")


_CLUSTERS = "clusters AS (SELECT page_num, component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cluster_count, list(idx ORDER BY idx) AS members FROM component JOIN items USING (page_num, idx) GROUP BY page_num, component)"


@query(f"{_R}, {_COMPONENTS}, {_CLUSTERS} SELECT page_num, component, x0, y0, x1, y1, cluster_count, members, row_number() OVER (PARTITION BY page_num ORDER BY component) AS position FROM clusters")
def cluster_boxes(spark, sf_dir):
    return media.cluster_boxes(fx.of_kind(spark, sf_dir, 3, 4), 20.0).drop("doc_id").withColumn("position", F.col("position").cast("long"))


_INSIDE = "{0}.x0 >= c.x0 AND {0}.y0 >= c.y0 AND {0}.x1 <= c.x1 AND {0}.y1 <= c.y1"
_COUNTED = f"""{fx.BLOCKS}, counted AS (SELECT c.*, (SELECT count(*) FROM items d WHERE d.page_num = c.page_num AND {_INSIDE.format('d')}) AS rectangles,
  (SELECT count(*) FROM blocks d WHERE d.page_num = c.page_num AND {_INSIDE.format('d')} AND text <> '' AND len(regexp_replace(text, '[{_WS}]', '', 'g')) <= 100) AS texts FROM clusters c)"""


def _drawings(spark, sf_dir):
    return fx.of_kind(spark, sf_dir, 3, 4)


@query(f"{_R}, {_COMPONENTS}, {_CLUSTERS}, {_COUNTED} SELECT page_num, component, rectangles, texts FROM counted")
def drawing_item_counts(spark, sf_dir):
    items = _drawings(spark, sf_dir)
    return media.count_items(media.cluster_boxes(items, 20.0), items, fx.blocks(spark, sf_dir)).select("page_num", "component", "rectangles", "texts")


_BLOCKED = f"""(d.x0 + d.x1) / 2 BETWEEN r.x0 AND r.x1 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 AND r.y1"""
_PRECEDENCE = f"""blocked AS (SELECT d.page_num, d.{{key}}, min(CASE r.kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS k FROM {{items}} d JOIN boxes r ON r.page_num = d.page_num AND r.kind IN (0, 1, 2)
  AND {_sql_overlap('d', 'r')} AND CASE WHEN r.kind = 0 THEN ({_BLOCKED}) OR {_sql_iou('d', 'r')} >= 0.8::DOUBLE ELSE {_sql_similar('d', 'r')} END GROUP BY d.page_num, d.{{key}})"""


def _reference(spark, sf_dir):
    boxes = fx.of_kind(spark, sf_dir, 0, 1, 2)
    return boxes.withColumn("kind", F.element_at(F.array(F.lit("tables"), F.lit("images"), F.lit("text_blocks")), (F.col("kind") + 1).cast("int")))


@query(f"{_B}, items AS (SELECT * FROM boxes WHERE kind IN (3, 4)), {_PRECEDENCE.format(key='idx', items='items')} SELECT page_num, idx, ['tables', 'images', 'text_blocks'][k] AS blocked_by FROM items LEFT JOIN blocked USING (page_num, idx)")
def table_precedence_anti(spark, sf_dir):
    return media.precedence(_drawings(spark, sf_dir), _reference(spark, sf_dir)).select("page_num", "idx", "blocked_by")


@query(f"""{_R}, {_COMPONENTS}, {_CLUSTERS}, {_COUNTED}, {_PRECEDENCE.format(key='component', items='counted')},
first AS (SELECT c.*, CASE WHEN {_CENTER} THEN 'margin' WHEN rectangles < 1 THEN 'min_items'
  WHEN greatest({_PX.format('x1 - x0')}, {_PX.format('y1 - y0')}) < 50 OR least({_PX.format('x1 - x0')}, {_PX.format('y1 - y0')}) < 12.5 THEN 'size' WHEN k IS NOT NULL THEN 'overlap' END AS skip
  FROM counted c LEFT JOIN blocked USING (page_num, component)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN skip IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS n FROM first)
SELECT page_num, component, coalesce(skip, CASE WHEN n > 2 THEN 'limit' END) AS skip, CASE WHEN skip IS NULL AND n <= 2 THEN printf('0_page_%04d_drawing_%02d.png', page_num, CAST(n AS BIGINT)) END AS filename FROM numbered""")
def drawing_cascade(spark, sf_dir):
    items = _drawings(spark, sf_dir)
    judged = media.judge_drawings(media.cluster_boxes(items, 20.0), items, fx.blocks(spark, sf_dir), _reference(spark, sf_dir), fx.pages(spark, sf_dir), _TWO)
    return judged.select("page_num", "component", "skip", "filename")


@query(f"""{_B}, pairs AS (SELECT i.page_num, i.idx AS img, d.idx AS dr, {_sql_area('i')} - {_sql_area('d')} AS more FROM boxes i JOIN boxes d ON i.page_num = d.page_num AND i.kind = 1 AND d.kind IN (3, 4)
  AND {_sql_overlap('i', 'd')} AND {_sql_inter('i', 'd')} / nullif(least({_sql_area('i')}, {_sql_area('d')}), 0) > 0.8::DOUBLE),
killed AS (SELECT page_num, img, min(dr) AS lost_to FROM pairs WHERE more < 0 GROUP BY page_num, img),
lost AS (SELECT p.page_num, p.dr, max(p.img) AS lost_to FROM pairs p LEFT JOIN killed k ON k.page_num = p.page_num AND k.img = p.img WHERE more > 0 AND (k.lost_to IS NULL OR k.lost_to > p.dr) GROUP BY p.page_num, p.dr)
SELECT page_num, 'image' AS what, img AS idx, lost_to FROM killed UNION ALL SELECT page_num, 'drawing', dr, lost_to FROM lost""")
def conflict_resolution(spark, sf_dir):
    images, drawings = media.resolve_conflicts(fx.images(spark, sf_dir), _drawings(spark, sf_dir))
    lost = lambda df, what, key: df.where("lost_to is not null").select("page_num", F.lit(what).alias("what"), F.col(key).alias("idx"), "lost_to")
    return lost(images, "image", "img_idx").unionByName(lost(drawings, "drawing", "idx"))


_ANCHORS = f"""kept AS (SELECT * FROM boxes WHERE {_LARGE}), xs AS (SELECT page_num, x0, row_number() OVER (PARTITION BY page_num ORDER BY x0) AS k FROM (SELECT DISTINCT page_num, x0 FROM kept)),
anchors(page_num, k, x0, anchor) AS (SELECT page_num, k, x0, x0 FROM xs WHERE k = 1
  UNION ALL SELECT x.page_num, x.k, x.x0, CASE WHEN x.x0 - a.anchor <= 50 THEN a.anchor ELSE x.x0 END FROM anchors a JOIN xs x ON x.page_num = a.page_num AND x.k = a.k + 1)"""


@query(f"{_R}, {_ANCHORS} SELECT page_num, idx, anchor FROM kept JOIN anchors USING (page_num, x0)")
def column_bins(spark, sf_dir):
    return layout.with_columns(fx.blocks(spark, sf_dir)).select("page_num", F.col("block_idx").alias("idx"), "anchor")


@query(f"{_R}, {_ANCHORS} SELECT page_num, idx, row_number() OVER (PARTITION BY page_num ORDER BY anchor, y0, x0, idx) AS position FROM kept JOIN anchors USING (page_num, x0)")
def reading_order(spark, sf_dir):
    return layout.reading_order(fx.blocks(spark, sf_dir)).select("page_num", F.col("block_idx").alias("idx"), F.col("position").cast("long").alias("position"))


@query(f"""{_B}, {fx.BLOCKS}, kept AS (SELECT * FROM blocks WHERE {_LARGE} AND NOT ({_STRICT}) AND {_strip_sql('text')} <> '')
SELECT page_num, idx, {_fix_sql('text')} AS text, {_joins_sql('text')} AS hyphens_fixed, {_words_sql(_fix_sql('text'))} AS word_count, CAST(len({_fix_sql('text')}) AS BIGINT) AS char_count FROM kept""")
def text_sections(spark, sf_dir):
    return layout.text_sections(fx.blocks(spark, sf_dir)).select("page_num", F.col("block_idx").alias("idx"), "text", "hyphens_fixed", "word_count", "char_count")


@query(f"""{_B} SELECT page_num, idx FROM boxes b WHERE kind = 2 AND NOT EXISTS (SELECT 1 FROM boxes t WHERE t.page_num = b.page_num AND t.kind IN (0, 3)
  AND (b.x0 >= t.x0 AND b.y0 >= t.y0 AND b.x1 <= t.x1 AND b.y1 <= t.y1 OR {_sql_overlap('b', 't')} AND {_sql_iou('b', 't')} > 0.9::DOUBLE
    AND abs({_sql_area('b')} - {_sql_area('t')}) / nullif(greatest({_sql_area('b')}, {_sql_area('t')}), 0) <= 0.2::DOUBLE))""")
def text_outside_tables(spark, sf_dir):
    return layout.outside_tables(fx.of_kind(spark, sf_dir, 2), fx.of_kind(spark, sf_dir, 0, 3)).select("page_num", "idx")


# Tables ------------------------------------------------------------------------------------------------------------

_G = f"{_B}, {fx.GRIDS}"
_SHOWN = f"list_transform(cells, lambda r: list_transform(r, lambda c: {_strip_sql(chr(99) + 'oalesce(c, ' + chr(39) + 'None' + chr(39) + ')')}))"
_FILLED = "lower({0}) NOT IN ('', 'null', 'none')"
_SHAPED = f"""shown AS (SELECT page_num, {_SHOWN} AS r FROM grids),
a AS (SELECT page_num, r, len(list_filter(r[1], lambda c: {_FILLED.format('c')})) = 1 AS h FROM shown),
b AS (SELECT page_num, CASE WHEN h THEN r[1][1] END AS headline, CASE WHEN h THEN r[2:] ELSE r END AS r FROM a),
c AS (SELECT *, len(r) > 1 AND len(list_filter(r[len(r)], lambda c: {_FILLED.format('c')})) = 1 AS d FROM b),
d AS (SELECT page_num, headline, CASE WHEN d THEN r[len(r)][1] END AS description, CASE WHEN d THEN r[:len(r) - 1] ELSE r END AS r FROM c),
e AS (SELECT *, coalesce(len(r[1]) >= 2 AND r[1][1] IN ('', 'null', 'none', '-', '_'), false) AS corner FROM d),
f AS (SELECT *, list_filter(CASE WHEN corner THEN r[1][2:] ELSE coalesce(r[1], []) END, lambda c: {_FILLED.format('c')}) AS n FROM e),
g AS (SELECT *, list_transform(n, lambda x, i: CASE WHEN len(list_filter(n[:i - 1], lambda y: y = x)) = 0 THEN x ELSE x || '_' || len(list_filter(n[:i - 1], lambda y: y = x)) END) AS headers FROM f)"""


def _grids(spark, sf_dir):
    return fx.grids(spark, sf_dir)


@query(f"""{_G} SELECT page_num, coalesce(len(cells) > 0 AND NOT (len(list_filter(cells, lambda r: len(list_filter(r, lambda c: lower({_strip_sql("coalesce(c, '')")}) NOT IN ('', 'null', 'none', 'nan', '-', '_'))) = 0)) / len(cells) > 0.75)
  AND len(list_filter(flatten({_SHOWN}), lambda c: {_FILLED.format('c')})) >= 3 AND NOT (len(cells) = 1 AND len(cells[1]) > 1), false) AS useful FROM grids""")
def table_useful(spark, sf_dir):
    return _grids(spark, sf_dir).select("page_num", tables.is_useful(F.col("cells")).alias("useful"))


@query(f"{_G}, {_SHAPED} SELECT page_num, headline, description, headers, corner FROM g")
def table_headers(spark, sf_dir):
    return tables.structured(_grids(spark, sf_dir)).select("page_num", "headline", "description", "headers", "corner")


def _long_rows(corner: bool) -> str:
    shift = 1 if corner else 0
    which = "corner AND len(headers) > 0" if corner else "NOT (corner AND len(headers) > 0)"
    label = "AND lower(row[1]) NOT IN ('', 'null', 'none')" if corner else ""
    return f"""{_G}, {_SHAPED}, body AS (SELECT page_num, headers, unnest(r[2:]) AS row, unnest(range(1, len(r))) AS row_no FROM g WHERE {which}),
cells AS (SELECT page_num, row_no, row, unnest(headers) AS header, unnest(range(1, len(headers) + 1)) AS j FROM body WHERE true {label}),
said AS (SELECT page_num, row_no, row[1] AS label, header, row[j + {shift}] AS value, j FROM cells WHERE row[j + {shift}] IS NOT NULL AND lower(row[j + {shift}]) NOT IN ('', 'null', 'none'))
SELECT page_num, {'label, ' if corner else ''}header, arg_max(value, j) AS value, CAST(count(DISTINCT row_no) AS BIGINT) AS n FROM (SELECT page_num, row_no, label, header, value, j FROM said QUALIFY row_number() OVER (PARTITION BY page_num, row_no, header ORDER BY j DESC) = 1) GROUP BY page_num, {'label, ' if corner else ''}header, row_no"""


@query(_long_rows(False))
def table_rows_standard(spark, sf_dir):
    rows = tables.structured(_grids(spark, sf_dir)).select("page_num", F.explode("standard_rows").alias("m"))
    return rows.select("page_num", F.explode("m").alias("header", "value")).withColumn("n", F.lit(1).cast("long"))


@query(_long_rows(True))
def table_rows_corner(spark, sf_dir):
    rows = tables.structured(_grids(spark, sf_dir)).select("page_num", F.explode("corner_rows").alias("x"))
    return rows.select("page_num", F.col("x.label").alias("label"), F.explode("x.cells").alias("header", "value")).withColumn("n", F.lit(1).cast("long"))


@query(f"""{_B}, tabs AS (SELECT *, (l_partkey % 3 > 0) AS useful, row_number() OVER (PARTITION BY page_num ORDER BY idx) AS number FROM boxes WHERE kind IN (0, 1, 3)),
prior AS (SELECT *, coalesce(sum(CASE WHEN NOT ({_CENTER}) AND useful THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tabs)
SELECT page_num, idx, number, CASE WHEN {_CENTER} THEN 'margin' WHEN before >= 2 THEN 'limit' WHEN NOT useful THEN 'useless' ELSE 'kept' END AS status FROM prior""")
def table_limit(spark, sf_dir):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))
    cells = F.when(F.col("l_partkey") % 3 > 0, rows).otherwise(F.array(F.array(F.lit("a"), F.lit("b"))))
    found = fx.of_kind(spark, sf_dir, 0, 1, 3).withColumn("table_num", F.col("idx")).withColumn("cells", cells)
    return tables.limited(found, fx.pages(spark, sf_dir), _TWO).select("page_num", "idx", F.col("number").cast("long").alias("number"), "status")


# Documents ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, list_sort(list_filter([CASE WHEN c_name <> '' THEN 'name=' || c_name END, CASE WHEN c_custkey % 3 > 0 THEN 'segment=' || c_mktsegment END], lambda x: x IS NOT NULL)) AS kept FROM customer")
def metadata_clean(spark, sf_dir):
    raw = F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), F.lit("empty"), F.lit(""))
    kept = F.transform(F.map_entries(t.clean_metadata(raw)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(kept).alias("kept"))


@query("""WITH n AS (SELECT p_partkey, CAST(p_size * (p_partkey % 4) AS BIGINT) AS n FROM part)
SELECT p_partkey, 1 AS first_page, n AS last_page FROM n WHERE n < 32
UNION ALL SELECT p_partkey, s, least(s + 7, n) FROM (SELECT p_partkey, n, unnest(range(1, n + 1, 8)) AS s FROM n WHERE n >= 32)""")
def chunk_split(spark, sf_dir):
    files = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * (F.col("p_partkey") % 4)).cast("int").alias("page_count"))
    return assemble.chunks(files).select("p_partkey", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"))


def _page_results(spark, sf_dir):
    """Lines of orders as pages' results: some failed, counters null where 0."""
    q = lambda c, m: F.nullif((F.col(c) % m).cast("long"), F.lit(0).cast("long"))
    lines = fx.table(spark, sf_dir, "lineitem").withColumn("page_num", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fx.ORDER)))
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), "page_num", F.concat(F.lit("P"), F.col("page_num").cast("string"), F.lit(";")).alias("content"),
        F.when(F.col("l_partkey") % 19 == 0, "failed").alias("error"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(2).cast("long")).alias("pages_failed"), F.lit(None).cast("long").alias("pages_processed"),
        q("l_partkey", 3).alias("images_saved"), q("l_suppkey", 4).alias("drawings_saved"), q("l_partkey", 5).alias("hyphens_fixed"), q("l_suppkey", 6).alias("table_hyphens_fixed"),
        q("l_partkey", 2).alias("tables_skipped"), q("l_partkey", 50).alias("word_count"), q("l_partkey", 300).alias("char_count"))


_RESULTS = """results AS (SELECT l_orderkey AS doc_id, l_partkey % 19 = 0 AS failed, CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 1 END AS pages_failed, l_partkey % 3 AS i, l_suppkey % 4 AS d, l_partkey % 5 AS h, l_suppkey % 6 AS th, l_partkey % 2 AS s, l_partkey % 50 AS w, l_partkey % 300 AS c,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page_num FROM lineitem)"""
_SUM = "CAST(sum(CASE WHEN failed THEN 0 ELSE {0} END) AS BIGINT) AS {1}"
_FILES = f"""files AS (SELECT doc_id, {', '.join(_SUM.format(a, b) for a, b in (('1', 'pages_processed'), ('i', 'images_saved'), ('d', 'drawings_saved'), ('h', 'hyphens_fixed'), ('th', 'table_hyphens_fixed'), ('s', 'tables_skipped'), ('w', 'word_count'), ('c', 'char_count')))},
  CAST(sum(CASE WHEN failed THEN pages_failed ELSE 0 END) AS BIGINT) AS errors, string_agg('P' || page_num || ';', '' ORDER BY page_num) AS body FROM results GROUP BY doc_id)"""


@query(f"WITH {_RESULTS}, {_FILES} SELECT * EXCLUDE (body) FROM files")
def file_rollup(spark, sf_dir):
    return assemble.file_rollup(_page_results(spark, sf_dir))


@query(f"WITH {_RESULTS}, {_FILES} SELECT count(*) AS files_processed, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('pages_processed', *assemble.SUMMED, 'errors'))} FROM files")
def global_rollup(spark, sf_dir):
    return assemble.global_rollup(assemble.file_rollup(_page_results(spark, sf_dir)))


@query(f"""WITH {_RESULTS}, {_FILES} SELECT doc_id, 'PDF: f' || doc_id || chr(10) || 'Media Directory: f' || doc_id || '_media' || chr(10) || 'Hyphen Fix: enabled' || chr(10) || 'Word Count: ' || word_count || chr(10) || 'Character Count: ' || char_count || chr(10)
  || 'Text Hyphens Fixed: ' || hyphens_fixed || chr(10) || 'Table Hyphens Fixed: ' || table_hyphens_fixed || chr(10) || repeat('=', 60) || chr(10) || chr(10) || body AS text FROM files""")
def page_assembly(spark, sf_dir):
    pages = _page_results(spark, sf_dir)
    files = pages.select("doc_id").distinct().withColumns({"filename": F.concat(F.lit("f"), F.col("doc_id").cast("string")), "metadata": F.create_map(F.lit("title"), F.lit(""))})
    return assemble.documents(pages, files).select("doc_id", "text")


# Descriptions ------------------------------------------------------------------------------------------------------


def _outputs(spark, sf_dir):
    """Assembled texts with a section of images, one that is no JSON, and one without a known list."""
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    item = lambda k, saved, old: F.format_string('{"index": %d, "saved": %s, "filename": "%s_%d.png", "description": "%s"}', F.lit(k), F.lit(saved), name, F.lit(k), old)
    first = F.concat(F.lit('```json\n{"images_with_resolution": ['), item(1, "true", F.lit("")), F.lit(", "), item(2, "false", F.lit("")), F.lit(", "), item(3, "false", F.when(F.col("doc_id") % 2 == 0, "old").otherwise("")), F.lit("]}\n```"))
    second = F.when(F.col("doc_id") % 3 == 0, "```json\n{broken\n```").otherwise('```json\n{"data_rows": []}\n```')
    text = F.concat(F.lit("head\n"), first, F.lit("\nmiddle\n"), second, F.lit("\ntail"))
    return fx.table(spark, sf_dir, "documents").select(F.format_string("/out/d%d.txt", "doc_id").alias("path"), text.alias("text"), F.lit("media").alias("media"), "doc_id")


def _sidecars(spark, sf_dir):
    """Descriptions of the first image of most documents, in one of two folders or both, and of the third of some."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    row = lambda d, k, where, text: d.select(F.lit(where).alias("folder"), F.format_string(f"m%d_{k}", "doc_id").alias("base"), F.format_string(text, "doc_id").alias("text"))
    return row(docs.where("doc_id % 5 > 0"), 1, "/out/media", "START of  picture %d end").unionByName(row(docs.where("doc_id % 7 = 0"), 1, "/out", " start end %d")).unionByName(row(docs.where("doc_id % 4 = 0"), 3, "/out/media", "end"))


_PICTURE = """CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 5 > 0 THEN 'of picture ' || doc_id END"""


@query("""SELECT doc_id, unnest([0, 1]) AS section, unnest([true, doc_id % 3 > 0]) AS valid FROM documents""")
def json_fences(spark, sf_dir):
    outputs = _outputs(spark, sf_dir)
    return enrich.parsed(enrich.sections(outputs)).join(outputs.select("path", "doc_id"), "path").select("doc_id", "section", "valid")


@query(f"""SELECT doc_id, 0 AS section, 0 AS item_no, {_PICTURE} AS description FROM documents
UNION ALL SELECT doc_id, 0, 2, CASE WHEN doc_id % 4 = 0 THEN 'No description available' END FROM documents WHERE doc_id % 2 = 0""")
def sidecar_lookup(spark, sf_dir):
    outputs = _outputs(spark, sf_dir)
    return enrich.described(outputs, _sidecars(spark, sf_dir)).join(outputs.select("path", "doc_id"), "path").select("doc_id", "section", "item_no", "description")


@query(f"""SELECT doc_id, 2 AS json_sections_processed, CASE WHEN ({_PICTURE}) IS NOT NULL THEN 1 ELSE 0 END AS first_pass_additions, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS second_pass_updates,
  CASE WHEN ({_PICTURE}) IS NULL THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS files_not_found, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS errors_occurred FROM documents""")
def description_counters(spark, sf_dir):
    outputs = _outputs(spark, sf_dir)
    return enrich.section_counters(outputs, _sidecars(spark, sf_dir)).join(outputs.select("path", "doc_id"), "path").drop("path")


@query(f"""SELECT doc_id, [{_PICTURE}, CASE WHEN doc_id % 4 = 0 THEN 'No description available' WHEN doc_id % 2 = 0 THEN 'old' END] AS descriptions, ({_PICTURE}) IS NOT NULL OR doc_id % 4 = 0 AS changed FROM documents""")
def description_inject(spark, sf_dir):
    made = enrich.injected(_outputs(spark, sf_dir), _sidecars(spark, sf_dir))
    body = F.get(t.fences(F.col("text")), F.lit(0))
    at = lambda k: F.nullif(F.get_json_object(body, f"$.images_with_resolution[{k}].description"), F.lit(""))
    return made.select("doc_id", F.array(at(0), at(2)).alias("descriptions"), "changed")


# Progress ----------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT event_id, count(*) OVER f AS in_window, arg_min(event_id, ts) OVER f AS a, arg_max(event_id, ts) OVER f AS b, min(ts) OVER f AS s, max(ts) OVER f AS e FROM events
  WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT event_id, in_window, CASE WHEN in_window < 2 OR s = e THEN 0 ELSE round((b - a) / (epoch_us(e) - epoch_us(s)) * 1000000, 6) END AS per_second FROM w""")
def progress_rolling_rate(spark, sf_dir):
    out = progress.rolling_rate(fx.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "1h", "event_id")
    return out.select("event_id", "in_window", F.round("per_second", 6).alias("per_second"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, event_id, last, emitted) AS (SELECT user_id, k, event_id, ts, true FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) >= 86400000000 THEN o.ts ELSE f.last END, epoch_us(o.ts) - epoch_us(f.last) >= 86400000000 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id FROM f WHERE emitted""")
def progress_throttle(spark, sf_dir):
    return progress.throttled(fx.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400.0).select("user_id", "event_id")


@query("SELECT event_id, row_number() OVER w AS done, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def progress_cumulative(spark, sf_dir):
    return progress.cumulative(fx.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "done", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def progress_latest(spark, sf_dir):
    return progress.latest(fx.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type")


@query("""WITH g AS (SELECT conv_id, turn + 1 AS attempt, text, len(text) AS n FROM conversations)
SELECT conv_id, md5(arg_min(text, attempt) FILTER (n BETWEEN 100 AND 3500)) AS digest, CAST(coalesce(min(attempt) FILTER (n BETWEEN 100 AND 3500), count(*)) AS BIGINT) AS attempts,
  CASE WHEN count(*) FILTER (n BETWEEN 100 AND 3500) > 0 THEN 'valid' WHEN coalesce(max(n), 0) < 100 THEN 'short' ELSE 'long' END AS outcome FROM g GROUP BY conv_id""")
def retry_best(spark, sf_dir):
    tries = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image"), (F.col("turn") + 1).alias("attempt"), F.col("text").alias("description"))
    return progress.best_attempt(tries).select(F.col("image").alias("conv_id"), F.md5("description").alias("digest"), F.col("attempts").cast("long").alias("attempts"), "outcome")


@query("""SELECT l_orderkey, l_linenumber, s, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS shown,
  CASE WHEN s > 0 THEN (l_partkey % 90) * 100 // s ELSE 0 END AS percent FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey * 7 % 9000 AS BIGINT) AS s FROM lineitem)""")
def format_eta(spark, sf_dir):
    s = (F.col("l_partkey") * 7 % 9000).cast("long")
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"), t.format_seconds(s).alias("shown"), t.percent(F.col("l_partkey") % 90, s).alias("percent"))


@query()
def describe_images(spark, sf_dir):
    """The describing run with the stand-in model over the pages' bytes."""
    images = fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("image"), F.to_binary("html", F.lit("utf-8")).alias("content"))
    return progress.best_attempt(describe.attempts(images)).select("image", F.md5("description").alias("digest"), "attempts", "outcome")


# Further rows of the inventory ------------------------------------------------------------------------------------


@query(f"{_B} SELECT page_num, idx, CAST({_PX.format('x1 - x0')} AS BIGINT) AS w, CAST({_PX.format('y1 - y0')} AS BIGINT) AS h, printf('f_page_%04d_img_%02d.png', page_num, idx) AS name, greatest(0, x0 - 5) AS cx0, least(612, x1 + 5) AS cx1 FROM boxes")
def pixel_sizes(spark, sf_dir):
    b = g.box()
    area = g.clamp(b, F.lit(fx.WIDTH), F.lit(fx.HEIGHT), 5.0)
    name = g.media_name(F.lit("f"), F.col("page_num").cast("int"), "img", F.col("idx").cast("int"))
    return fx.boxes(spark, sf_dir).select("page_num", "idx", g.pixels(b.width).alias("w"), g.pixels(b.height).alias("h"), name.alias("name"), area.x0.alias("cx0"), area.x1.alias("cx1"))


@query("""SELECT p_partkey, CAST(trunc(w * (1024.0::DOUBLE / greatest(w, h))) AS BIGINT) AS fw, CAST(trunc(h * (1024.0::DOUBLE / greatest(w, h))) AS BIGINT) AS fh FROM (SELECT p_partkey, p_size * 16 AS w, 100 + p_partkey % 900 AS h FROM part)""")
def fitted_sizes(spark, sf_dir):
    w, h = g.fitted_size(F.col("p_size") * 16, 100 + F.col("p_partkey") % 900, 1024)
    return fx.table(spark, sf_dir, "part").select("p_partkey", w.alias("fw"), h.alias("fh"))


@query(f"""{_B}, {fx.BLOCKS} SELECT page_num, idx FROM blocks WHERE text <> '' AND len(regexp_replace(text, '[{_WS}]', '', 'g')) <= 80 AND (len(text) - len(regexp_replace(text, '[{t.EUROPEAN}]', '', 'g'))) / len(text) > 0.5 AND {_LARGE}""")
def small_text_blocks(spark, sf_dir):
    return media.small_text(fx.blocks(spark, sf_dir)).select("page_num", F.col("block_idx").alias("idx"))


@query(f"{_B} SELECT i.page_num, i.idx FROM boxes i WHERE i.kind <> 2 AND EXISTS (SELECT 1 FROM boxes t WHERE t.page_num = i.page_num AND t.kind = 2 AND {_sql_similar('i', 't', 0.9)})")
def text_overlap_semi(spark, sf_dir):
    items = fx.of_kind(spark, sf_dir, 0, 1, 3, 4)
    return media.over_text(items, fx.of_kind(spark, sf_dir, 2)).select("page_num", "idx")


@query(f"""{_B} SELECT a.page_num, a.idx AS idx_a, b.idx AS idx_b, round({_DISTANCE}, 6) AS distance FROM boxes a JOIN boxes b ON a.page_num = b.page_num AND a.idx < b.idx AND a.kind = 1 AND b.kind <> 1""")
def box_distances(spark, sf_dir):
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    pairs = media.pairs_within(fx.of_kind(spark, sf_dir, 1), fx.of_kind(spark, sf_dir, 0, 2, 3, 4), "idx", lambda x, y: F.lit(True))
    return pairs.select("page_num", "idx_a", "idx_b", F.round(g.distance(a, b), 6).alias("distance"))


@query("""SELECT url, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '' END AS folder, regexp_extract(url, '[^/]*$') AS name, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages""".replace("\\\\", "\\"))
def path_parts(spark, sf_dir):
    u = F.col("url")
    return fx.table(spark, sf_dir, "pages").select("url", t.folder(u).alias("folder"), t.base_name(u).alias("name"), t.stem(u).alias("stem"))


@query("""SELECT DISTINCT user_id AS path FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def list_dedupe(spark, sf_dir):
    from quirefold.sources import files

    found = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"))
    return files.new_paths(found, fx.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path")))


@query(f"""WITH {_RESULTS}, c AS (SELECT doc_id, page_num, failed, (page_num - 1) // 2 AS chunk, max(failed) OVER w AS lost, min(page_num) OVER w AS first, count(*) OVER w AS n FROM results WINDOW w AS (PARTITION BY doc_id, (page_num - 1) // 2))
SELECT doc_id, page_num, lost AS failed, CASE WHEN lost THEN n ELSE 0 END AS pages_failed FROM c WHERE NOT lost OR page_num = first""")
def chunk_errors(spark, sf_dir):
    pages = _page_results(spark, sf_dir).withColumn("chunk", F.expr("(page_num - 1) div 2")).drop("pages_failed")
    out = assemble.isolate_errors(pages, whole_chunk=True)
    return out.select("doc_id", "page_num", F.col("error").isNotNull().alias("failed"), F.col("pages_failed").cast("long").alias("pages_failed"))


@query("""WITH g AS (SELECT conv_id, count(*) FILTER (len(text) BETWEEN 100 AND 3500) AS good, max(len(text)) AS longest FROM conversations GROUP BY conv_id)
SELECT count(*) AS processed, count(*) FILTER (good > 0) AS valid, count(*) FILTER (good = 0 AND longest < 100) AS short, count(*) FILTER (good = 0 AND longest >= 100) AS long FROM g""")
def describe_summary(spark, sf_dir):
    tries = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image"), (F.col("turn") + 1).alias("attempt"), F.col("text").alias("description"))
    return progress.run_summary(progress.best_attempt(tries)).drop("failed")


@query("""WITH last AS (SELECT user_id, event_id % 40 AS done, 40 AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(sum(done) AS BIGINT) AS pages_done, CAST(sum(total) AS BIGINT) AS total_pages, CAST(sum(done) * 100 // sum(total) AS BIGINT) AS percent FROM last""")
def progress_sums(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("file"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("pages_done"), F.lit(40).alias("total_pages"), F.lit(0).alias("images"), F.lit(0).alias("drawings"))
    return progress.progress_totals(events).select(*(F.col(c).cast("long").alias(c) for c in ("pages_done", "total_pages", "percent")))


@query("""SELECT event_id, CASE WHEN s > 0 THEN round(n / s, 6) ELSE 0 END AS rate, CASE WHEN n > 0 AND s > 0 THEN round((40 - n) / (n / s), 6) END AS remaining FROM (SELECT event_id, CAST(event_id % 40 AS DOUBLE) AS n, CAST(event_id % 13 AS DOUBLE) AS s FROM events)""")
def rates(spark, sf_dir):
    n, s = (F.col("event_id") % 40).cast("double"), (F.col("event_id") % 13).cast("double")
    return fx.table(spark, sf_dir, "events").select("event_id", F.round(t.rate(n, s), 6).alias("rate"), F.round(t.remaining_seconds(n, F.lit(40.0), s), 6).alias("remaining"))


@query(f"""SELECT doc_id, md5({_strip_sql("regexp_replace('# **' || text || '** ', '\\*\\*|#', '', 'g')".replace("\\\\", "\\"))}) AS answer, coalesce(nullif({_strip_sql("regexp_replace(regexp_replace('Start of ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' weekend END' ELSE '' END, '(?i)\\b(start|end)\\b', '', 'g'), ' +', ' ', 'g')".replace("\\\\", "\\"))}, ''), 'No description available') AS sidecar FROM documents""")
def description_clean(spark, sf_dir):
    answer = F.concat(F.lit("# **"), "text", F.lit("** "))
    sidecar = F.concat(F.lit("Start of "), "lang", F.when(F.col("doc_id") % 2 == 0, " weekend END").otherwise(""))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(t.clean_description(answer)).alias("answer"), t.clean_sidecar(sidecar).alias("sidecar"))


@query(f"""SELECT CAST(2 * count(*) AS BIGINT) AS json_sections_processed, CAST(sum(CASE WHEN ({_PICTURE}) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS first_pass_additions, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS second_pass_updates,
  CAST(sum(CASE WHEN ({_PICTURE}) IS NULL THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS files_not_found, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors_occurred FROM documents""")
def description_totals(spark, sf_dir):
    return enrich.totals(enrich.section_counters(_outputs(spark, sf_dir), _sidecars(spark, sf_dir)))


@query(f"""{_B}, p AS (SELECT DISTINCT page_num FROM boxes), {_IMAGES.format('1')}, {_JUDGED.format(30)}, s AS (SELECT page_num, count(*) AS n FROM judged GROUP BY page_num)
SELECT page_num, CASE WHEN n IS NULL THEN 'No images detected on page ' || page_num || '.' ELSE 'IMAGES FOUND ON PAGE ' || page_num || ': ' || n END AS head FROM p LEFT JOIN s USING (page_num)""")
def media_sections(spark, sf_dir):
    summary = assemble.image_summary(_judged(spark, sf_dir, LayoutConfig(min_size_px=30)))
    made = assemble.media_section(summary, fx.pages(spark, sf_dir), "image")
    return made.select("page_num", F.regexp_extract("section", r"^\n*([^\n]*)", 1).alias("head"))


@query(f"""{_B}, wide AS (SELECT page_num, idx AS img_idx, CASE WHEN page_num % 7 = 0 THEN 0 ELSE x0 END AS x0, CASE WHEN page_num % 7 = 0 THEN 0 ELSE y0 END AS y0, CASE WHEN page_num % 7 = 0 THEN 551 ELSE x1 END AS x1, CASE WHEN page_num % 7 = 0 THEN 713 ELSE y1 END AS y1 FROM boxes WHERE kind = 1)
SELECT page_num, img_idx, printf('full-page image (%.0fx%.0fpts vs page 612x792pts)', CAST(x1 - x0 AS DOUBLE), CAST(y1 - y0 AS DOUBLE)) AS reason FROM wide WHERE x1 - x0 >= 0.8::DOUBLE * 612 AND y1 - y0 >= 0.8::DOUBLE * 792""")
def full_page_images(spark, sf_dir):
    """The reasons of images that cover their page, which the boxes' own images never do."""
    images = fx.images(spark, sf_dir)
    for c, wide in (("x0", 0.0), ("y0", 0.0), ("x1", 551.0), ("y1", 713.0)):
        images = images.withColumn(c, F.when(F.col("page_num") % 7 == 0, wide).otherwise(F.col(c)))
    side = lambda a, b: g.pixels(F.col(b) - F.col(a))
    images = images.withColumns({"px_width": side("x0", "x1"), "px_height": side("y0", "y1")})
    judged = media.judge_images(images, fx.of_kind(spark, sf_dir, 2), fx.pages(spark, sf_dir), LayoutConfig(min_size_px=30))
    return judged.where(F.startswith("reason", F.lit("full-page"))).select("page_num", "img_idx", "reason")


@query(f"""{_B}, pairs AS (SELECT i.page_num, i.idx AS img, d.idx AS dr, {_sql_inter('i', 'd')} / nullif(least({_sql_area('i')}, {_sql_area('d')}), 0) AS share FROM boxes i JOIN boxes d ON i.page_num = d.page_num AND i.kind = 1 AND d.kind IN (3, 4)
  AND {_sql_overlap('i', 'd')} AND {_sql_inter('i', 'd')} / nullif(least({_sql_area('i')}, {_sql_area('d')}), 0) > 0.8::DOUBLE AND {_sql_area('i')} < {_sql_area('d')})
SELECT page_num, img, printf('Overlap with larger drawing (%.1f%% coverage)', arg_min(share, dr) * 100) AS reason FROM pairs GROUP BY page_num, img""")
def conflict_reasons(spark, sf_dir):
    images, _ = media.resolve_conflicts(fx.images(spark, sf_dir), _drawings(spark, sf_dir))
    return images.where("lost_to is not null").select("page_num", F.col("img_idx").alias("img"), media.conflict_reason(F.col("share"), "drawing").alias("reason"))


@query("""SELECT l_orderkey, l_suppkey % 5 AS page_num, '--- Page ' || (l_suppkey % 5) || ' ---' || chr(10) || chr(10) || string_agg(l_partkey || ';', '' ORDER BY l_linenumber % 4, l_quantity, l_partkey || ';') AS content
FROM lineitem GROUP BY l_orderkey, l_suppkey % 5""")
def page_sections(spark, sf_dir):
    """Lines of orders as fragments of pages: tables, texts, images and drawings."""
    kind = F.element_at(F.array(*map(F.lit, ("table", "text", "image", "drawing"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 5).alias("page_num"), kind.alias("kind"), F.col("l_quantity").alias("position"), F.concat(F.col("l_partkey").cast("string"), F.lit(";")).alias("section"))
    return assemble.pages_of(lines).select(F.col("doc_id").alias("l_orderkey"), "page_num", "content")


@query("""SELECT l_orderkey, l_linenumber, nullif(CAST(sum(l_partkey % 3) AS BIGINT), 0) AS images_saved, nullif(CAST(sum(l_suppkey % 2) AS BIGINT), 0) AS tables_skipped FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def page_counter_sums(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), (F.col("l_partkey") % 3).alias("images_saved"), (F.col("l_suppkey") % 2).alias("tables_skipped"))
    return assemble.page_counters(parts, "images_saved", "tables_skipped").withColumnsRenamed({"doc_id": "l_orderkey", "page_num": "l_linenumber"})


_STATES = """['Ready', 'Done', 'Error', 'Scanning'][CAST(p_size % 4 + 1 AS INT)]"""


def _states(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("Ready", "Done", "Error", "Scanning"))), (F.col("p_size") % 4 + 1).cast("int"))
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), status.alias("status"), F.nullif(F.col("p_partkey") % 9, F.lit(0)).alias("page_count"))


@query(f"SELECT p_partkey AS path, {_STATES} AS status FROM part WHERE {_STATES} IN ('Ready', 'Done')")
def eligible_files(spark, sf_dir):
    return progress.eligible_files(_states(spark, sf_dir)).select("path", "status")


@query("SELECT count(*) AS files, CAST(sum(nullif(p_partkey % 9, 0)) AS BIGINT) AS pages FROM part")
def scan_totals(spark, sf_dir):
    return progress.scan_totals(_states(spark, sf_dir))


@query("SELECT l_orderkey, bool_or(l_linenumber % 5 IN (0, 1)) AS lines FROM lineitem GROUP BY l_orderkey")
def pages_with_lines(spark, sf_dir):
    """Whether the vector items of a page (an order's lines) can rule a table."""
    kind = F.element_at(F.array(*map(F.lit, ("l", "re", "c", "qu", "x"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    pages = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(kind).alias("kinds"))
    return pages.select("l_orderkey", tables.has_lines(F.col("kinds")).alias("lines"))


@query("SELECT page_id, md5('data:image/jpeg;base64,' || base64(encode(html))) AS digest FROM pages")
def data_uris(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.md5(describe.data_uri(F.to_binary("html", F.lit("utf-8")))).alias("digest"))


def _folder_inputs(spark, sf_dir):
    """Texts of which every third names a media folder, and the folders that exist."""
    ids = fx.table(spark, sf_dir, "documents").select("doc_id")
    head = F.when(F.col("doc_id") % 3 == 0, F.format_string("PDF: d\nMedia Directory: m%d \nWord Count: 1\n", "doc_id")).otherwise("PDF: d\n")
    outputs = ids.select("doc_id", F.format_string("/out/d%d.txt", "doc_id").alias("path"), head.alias("text"))
    listing = ids.where("doc_id % 2 = 0").select(F.format_string("/out/m%d", "doc_id").alias("folder")).unionByName(ids.where("doc_id % 5 > 0").select(F.format_string("/out/d%d_media", "doc_id").alias("folder")))
    return outputs, listing


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'm' || doc_id WHEN doc_id % 5 > 0 THEN 'd' || doc_id || '_media' END AS media FROM documents""")
def media_folders(spark, sf_dir):
    return enrich.folders(*_folder_inputs(spark, sf_dir)).select("doc_id", "media")


@query("""SELECT doc_id, CASE WHEN s THEN 0 ELSE 2 END AS json_sections_processed, CASE WHEN s THEN 0 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS first_pass_additions, 0 AS second_pass_updates,
  CASE WHEN s THEN 0 ELSE CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END END AS files_not_found, CASE WHEN NOT s AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS errors_occurred, CASE WHEN s THEN 1 ELSE 0 END AS skipped
FROM (SELECT doc_id, doc_id % 5 = 0 AS s FROM documents)""")
def folder_counters(spark, sf_dir):
    """A folder of texts: media folders by stem, sidecars beside the texts only count, texts without a folder are skipped."""
    outputs, (_, listing) = _outputs(spark, sf_dir).drop("media"), _folder_inputs(spark, sf_dir)
    _, counters = enrich.process_folder(outputs.select("path", "text"), listing, _sidecars(spark, sf_dir))
    return counters.join(outputs.select("path", "doc_id"), "path").drop("path")


@query(f"""{_G}, {_SHAPED}, counted AS (SELECT *, CASE WHEN corner AND len(headers) > 0 THEN 1 ELSE 0 END AS shift, r[2:] AS body FROM g)
SELECT page_num, 8 AS n_keys, headers, headline, description, CAST(len(list_filter(body, lambda row: (shift = 0 OR lower(coalesce(row[1], '')) NOT IN ('', 'null', 'none')) AND
  len(list_filter(range(1, len(headers) + 1), lambda j: row[j + shift] IS NOT NULL AND lower(row[j + shift]) NOT IN ('', 'null', 'none'))) > 0)) AS BIGINT) AS n_rows FROM counted""")
def table_sections(spark, sf_dir):
    """What the JSON records of table sections say."""
    made = tables.section_text(tables.structured(_grids(spark, sf_dir).withColumn("number", F.lit(1))))
    record = F.regexp_extract("section", r"(?s)```json\n(.*)\n```", 1)
    read = F.from_json(record, "table_number int, page_number long, type string, headline string, description string, column_headers array<string>, data_rows_count long, data_rows array<map<string,string>>")
    return made.select("page_num", F.size(F.map_keys(F.from_json(record, "map<string,string>"))).alias("n_keys"), read.alias("x")).select(
        "page_num", "n_keys", F.col("x.column_headers").alias("headers"), F.col("x.headline").alias("headline"), F.col("x.description").alias("description"), F.size("x.data_rows").cast("long").alias("n_rows"))
