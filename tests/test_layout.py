"""Literal edge cases of boxes, tables, chunks and assembly."""

import itertools
import json
import math
import random

from pyspark.sql import functions as F

from quirefold.config import LayoutConfig
from quirefold.functions import geometry as g
from quirefold.operators import assemble, enrich, layout, media, tables

PAGE = dict(doc_id=1, page_num=1)


def pair(spark, a, b, *columns):
    df = spark.createDataFrame([(*map(float, a), *map(float, b))], "x0_a double, y0_a double, x1_a double, y1_a double, x0_b double, y0_b double, x1_b double, y1_b double")
    return df.select(*(c(g.box(suffix="_a"), g.box(suffix="_b")).alias(str(i)) for i, c in enumerate(columns))).first()


def test_overlap_and_distance(spark):
    show = lambda a, b: tuple(pair(spark, a, b, g.iou, g.overlaps, g.distance, g.similar))
    assert show((0, 0, 2, 2), (0, 0, 2, 2)) == (1.0, True, -2.0, True)
    assert show((0, 0, 2, 2), (2, 0, 4, 2))[:3] == (0.0, False, 0.0)
    assert show((0, 0, 4, 4), (1, 1, 3, 3))[:2] == (0.25, True)
    assert show((0, 0, 1, 1), (4, 5, 6, 6))[:3] == (0.0, False, 5.0)
    assert show((1, 1, 1, 1), (1, 1, 1, 1)) == (0.0, False, 0.0, False)
    assert show((0, 0, 2, 2), (1, 7, 3, 9))[2] == 5.0


def test_iou_is_symmetric(spark):
    r = random.Random(1)
    rows = [tuple(float(r.randrange(20)) for _ in range(8)) for _ in range(300)]
    rows = [(min(a, c), min(b, d), max(a, c), max(b, d), min(e, x), min(f, y), max(e, x), max(f, y)) for a, b, c, d, e, f, x, y in rows]
    df = spark.createDataFrame(rows, "x0_a double, y0_a double, x1_a double, y1_a double, x0_b double, y0_b double, x1_b double, y1_b double")
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    assert all(r.p == r.q and 0 <= r.p <= 1 for r in df.select(g.iou(a, b).alias("p"), g.iou(b, a).alias("q")).collect())


def test_column_anchors(spark):
    df = spark.createDataFrame([([0.0, 40.0, 60.0, 90.0, 115.0, 200.0],), ([],)], "xs array<double>")
    assert [r.a for r in df.select(layout.column_anchors(F.col("xs"), 50.0).alias("a")).collect()] == [[0.0, 0.0, 60.0, 60.0, 115.0, 200.0], []]


def test_conflicts_in_order(spark):
    r = random.Random(3)
    images, drawings = [], []
    for page in range(60):
        for k in range(4):
            x, y = r.randrange(4), r.randrange(4)
            images.append((1, page, k, float(x), float(y), x + r.choice([9.0, 10.0, 11.0]), y + r.choice([9.0, 10.0])))
            x, y = r.randrange(4), r.randrange(4)
            drawings.append((1, page, k, float(x), float(y), x + r.choice([9.0, 10.0, 11.0]), y + r.choice([9.0, 10.0])))
    schema = "doc_id int, page_num int, {} int, x0 double, y0 double, x1 double, y1 double"
    i, d = media.resolve_conflicts(spark.createDataFrame(images, schema.format("img_idx")), spark.createDataFrame(drawings, schema.format("idx")))
    got = ({(x.page_num, x.img_idx): x.lost_to for x in i.collect()}, {(x.page_num, x.idx): x.lost_to for x in d.collect()})
    want = ({(x[1], x[2]): None for x in images}, {(x[1], x[2]): None for x in drawings})
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    for page in range(60):  # one drawing after the other, each against the images that are left
        for dr in (x for x in drawings if x[1] == page):
            for im in (x for x in images if x[1] == page):
                if want[0][im[1], im[2]] is not None:
                    continue
                w, h = min(dr[5], im[5]) - max(dr[3], im[3]), min(dr[6], im[6]) - max(dr[4], im[4])
                if w > 0 and h > 0 and w * h / min(area(dr), area(im)) > 0.8:
                    if area(im) < area(dr):
                        want[0][im[1], im[2]] = dr[2]
                    elif area(im) > area(dr):
                        want[1][dr[1], dr[2]] = im[2]
    assert got == want


def test_clusters_do_not_depend_on_order(spark):
    r = random.Random(5)
    rows = [(1, p, k, x := r.randrange(300) * 1.0, y := r.randrange(300) * 1.0, x + r.randrange(1, 200), y + 10.0) for p in range(12) for k in range(25)]
    schema = "doc_id int, page_num int, idx int, x0 double, y0 double, x1 double, y1 double"
    want = {}
    for p in range(12):
        own = [x for x in rows if x[1] == p]
        low = {x[2]: x[2] for x in own}
        for _ in own:
            for a, b in itertools.combinations(own, 2):
                dx, dy = max(a[3] - b[5], b[3] - a[5], 0), max(a[4] - b[6], b[4] - a[6], 0)
                if math.hypot(dx, dy) <= 20:
                    low[a[2]] = low[b[2]] = min(low[a[2]], low[b[2]])
        want |= {(p, k): v for k, v in low.items()}
    for parts in (1, 16):
        r.shuffle(rows)
        got = media.clusters(spark.createDataFrame(rows, schema).repartition(parts), 20.0).collect()
        assert {(x.page_num, x.idx): x.component for x in got} == want


def useful(spark, cells):
    return spark.createDataFrame([(cells,)], "cells array<array<string>>").select(tables.is_useful(F.col("cells"))).first()[0]


def test_useful_tables(spark):
    row, empty = ["a", "b", "c"], ["", None, "-"]
    assert useful(spark, [row, empty, empty, empty]) and not useful(spark, [row, empty, empty, empty, empty])
    assert not useful(spark, [["a", "b"], ["", None]]) and useful(spark, [["a", "-"], ["nan", "x"]])
    assert not useful(spark, [row]) and not useful(spark, [["a"]]) and not useful(spark, []) and not useful(spark, None)


def structure(spark, cells):
    return tables.structured(spark.createDataFrame([(1, cells)], "doc_id int, cells array<array<string>>")).first()


def test_table_structure(spark):
    x = structure(spark, [["Title", None, ""], ["A", "A", "A"], ["1", "null", "3"], ["", "", ""], ["end", None, "none"]])
    assert (x.headline, x.description, x.headers, x.corner, x.type) == ("Title", "end", ["A", "A_1", "A_2"], False, "headline")
    assert x.standard_rows == [{"A": "1", "A_2": "3"}]
    x = structure(spark, [[None, "only"], ["-", "h1", None, "h2"], ["r", "1", "2", "3"], ["none", "4", "5", "6"]])
    assert (x.headline, x.corner, x.headers) == ("None", True, ["h1", "h2"])
    assert [(r.label, r.cells) for r in x.corner_rows] == [("r", {"h1": "1", "h2": "2"})] and x.standard_rows == []
    x = structure(spark, [["NONE", "h"], ["a", "b"]])
    assert (x.headline, x.headers) == ("NONE", ["a", "b"])
    x = structure(spark, [[None, "h1", "h2"], ["a", "b", "c"]])
    assert not x.corner and x.headers == ["h1", "h2"] and x.standard_rows == [{"h1": "a", "h2": "b"}]
    x = structure(spark, [["A", "A_1", "A"], ["1", "2", "3"]])
    assert x.headers == ["A", "A_1", "A_1"] and x.standard_rows == [{"A": "1", "A_1": "3"}]
    assert structure(spark, []).type == "no_data" and structure(spark, None).standard_rows == []
    counted = tables.counted_text(tables.structured(spark.createDataFrame([(1, [["A", "B"], ["x y", "z"]])], "doc_id int, cells array<array<string>>"))).first()
    assert counted.word_count == 7


def test_chunks(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 31, 32, 33, 40, 41)], "page_count int")
    got = {}
    for r in assemble.chunks(df).collect():
        got.setdefault(r.page_count, []).append((r.first_page, r.last_page))
    assert got[0] == [(1, 0)] and got[1] == [(1, 1)] and got[31] == [(1, 31)] and sorted(got[33])[-1] == (33, 33) and len(got[41]) == 6
    for n in (32, 33, 40, 41):
        assert [p for a, b in sorted(got[n]) for p in range(a, b + 1)] == list(range(1, n + 1))


def test_errors_by_page_or_chunk(spark):
    rows = [("d", 1, 1, "a", None), ("d", 2, 1, "b", "bad"), ("d", 3, 2, "c", None)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, chunk int, content string, error string")
    assert assemble.isolate_errors(df).count() == 3
    got = sorted((r.page_num, r.content, r.error, r.pages_failed) for r in assemble.isolate_errors(df, whole_chunk=True).collect())
    assert got == [(1, "", "bad", 2), (3, "c", None, 0)]


def test_page_text_order_and_sections(spark):
    f = spark.createDataFrame([("d", 1, "image", 1, "I"), ("d", 1, "text", 2, "b"), ("d", 1, "table", 1, "T"), ("d", 1, "text", 1, "a"), ("d", 1, "drawing", 1, "D")], "doc_id string, page_num int, kind string, position int, section string")
    assert assemble.pages_of(f).first().content.endswith("TabID")
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_num int")
    summary = spark.createDataFrame([("d", 1, 3, 2)], "doc_id string, page_num int, image_count int, images_saved int")
    got = {r.page_num: r.section for r in assemble.media_section(summary, pages, "image").collect()}
    assert "IMAGES FOUND ON PAGE 1: 3" in got[1] and got[2] == "No images detected on page 2.\n\n"
    off = assemble.media_section(summary.limit(0), pages, "image", LayoutConfig(save_images=False)).first().section
    assert off.startswith("Image extraction disabled")


def test_sections_counters_and_summaries(spark):
    cells = [["T", None], ["A", "B"], ["1", "2"]]
    made = tables.section_text(tables.structured(spark.createDataFrame([("d", 2, 1, cells)], "doc_id string, page_num int, number int, cells array<array<string>>"))).first().section
    assert made.startswith("\n\nTABLE 1 ON PAGE 2\n\nType: headline\nHas Header: True\nData Rows: 1\nHeadline: T\n```json\n{")
    record = {"table_number": 1, "page_number": 2, "type": "headline", "headline": "T", "description": None, "column_headers": ["A", "B"], "data_rows_count": 1, "data_rows": [{"A": "1", "B": "2"}]}
    assert made.split("```json\n")[1] == json.dumps(record, indent=2, ensure_ascii=False) + "\n```\n\n"
    cells = [["", 'H "1"', "h\u00e92"], ["r\\1", "x", None], ["none", "y", "z"], ["r2", "a\tb", "c"]]
    made = tables.section_text(tables.structured(spark.createDataFrame([("d", 2, 1, cells), ("d", 3, 1, [])], "doc_id string, page_num int, number int, cells array<array<string>>"))).orderBy("page_num").collect()
    record = {"table_number": 1, "page_number": 2, "type": "standard", "headline": None, "description": None, "column_headers": ['H "1"', "h\u00e92"], "data_rows_count": 2, "data_rows": [{"r\\1": {'H "1"': "x"}}, {"r2": {'H "1"': "a\tb", "h\u00e92": "c"}}]}
    assert made[0].section.split("```json\n")[1] == json.dumps(record, indent=2, ensure_ascii=False) + "\n```\n\n"
    assert '"column_headers": [],' in made[1].section and '"data_rows": []\n}' in made[1].section
    parts = spark.createDataFrame([("d", 1, 2, 0), ("d", 1, 3, 0)], "doc_id string, page_num int, words int, skipped int")
    assert tuple(assemble.page_counters(parts, "words", "skipped").first()) == ("d", 1, 5, None)
    drawn = spark.createDataFrame([("d", 1, 1, [3, 4], True, "a.png", None), ("d", 1, 2, [5, 6], False, "b.png", "larger")], "doc_id string, page_num int, number int, resolution array<int>, saved boolean, filename string, skipped_reason string")
    got = assemble.drawing_summary(drawn).first()
    assert (got.drawing_count, got.drawings_saved, got.drawings_failed, [x["index"] for x in got.drawings_with_resolution]) == (2, 1, 1, [0, 1])
    shares = spark.createDataFrame([(0.875,)], "s double").select(media.conflict_reason(F.col("s"), "image")).first()[0]
    assert shares == "Overlap with larger image (87.5% coverage)"
    lines = spark.createDataFrame([(["c", "re"],), (["c"],), (None,)], "k array<string>")
    assert [r.h for r in lines.select(tables.has_lines(F.col("k")).alias("h")).collect()] == [True, False, False]
    top = spark.createDataFrame([("d", 1, k) for k in range(5)], "doc_id string, page_num int, idx int")
    assert sorted(r.idx for r in media.first_per_page(top, "idx", 2).collect()) == [0, 1]
    b = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],)], "v array<double>").select(g.box_of(F.col("v")).area.alias("a")).collect()
    assert [r.a for r in b] == [4.0, None]


def test_media_folder_and_idempotent_injection(spark):
    text = 'Media Directory: pics\n```json\n{"a": 1, "images_with_resolution": [{"saved": "true", "filename": "f.png"}], "drawings_with_resolution": [{"saved": true, "filename": "g.png"}]}\n```\n'
    outputs = spark.createDataFrame([("/o/x.txt", text), ("/o/y.txt", "plain")], "path string, text string")
    listing = spark.createDataFrame([("/o/pics",), ("/o/y_media",)], "folder string")
    placed = enrich.folders(outputs, listing)
    assert {r.path: r.media for r in placed.collect()} == {"/o/x.txt": "pics", "/o/y.txt": "y_media"}
    sidecars = spark.createDataFrame([("/o/pics", "f", "a start picture"), ("/o", "g", "second list stays")], "folder string, base string, text string")
    once = enrich.injected(placed, sidecars)
    got = {r.path: (r.text, r.changed) for r in once.collect()}
    assert '"description":"a picture"' in got["/o/x.txt"][0] and "second list stays" not in got["/o/x.txt"][0] and got["/o/x.txt"][0].startswith("Media Directory: pics\n```json\n{") and '"a": 1' in got["/o/x.txt"][0]
    assert got["/o/y.txt"] == ("plain", False)
    again = {r.path: r.text for r in enrich.injected(once.drop("changed"), sidecars).collect()}
    assert again == {p: x for p, (x, _) in got.items()}
    done, counters = enrich.process_folder(outputs.unionByName(spark.createDataFrame([("/o/z.txt", "no folder")], "path string, text string")), listing, sidecars)
    assert [r.path for r in done.collect()] == ["/o/x.txt"]
    assert {r.path: (r.first_pass_additions, r.skipped) for r in counters.collect()} == {"/o/x.txt": (1, 0), "/o/y.txt": (0, 0), "/o/z.txt": (0, 1)}
    assert enrich.totals(counters).first().skipped == 1


def test_injection_keeps_what_it_does_not_know(spark):
    section = {
        "zeta": "5", "alpha": None, "on": "true", "nested": {"b": [1, "2", None], "a": 1.50},
        "figures": [{"saved": True, "filename": "f.v2.png", "custom": {"k": ["x", 1]}, "note": "7", "none": None, "caption \"q\"": "a\\b\n\u00e9"}, "loose", {"saved": "false", "filename": "g.png"},
                    {"description": "old", "filename": "h.png", "index": "three"}],
    }
    text = "Head\n```json\n" + json.dumps(section, indent=2, ensure_ascii=False) + "\n```\ntail\n```json\n{ not json }\n```\n"
    outputs = spark.createDataFrame([("/o/x.txt", text, "pics"), (None, None, None)], "path string, text string, media string")
    sidecars = spark.createDataFrame([("/o/pics", "f.v2", 'start a "picture"'), ("/o", "g", "not saved"), ("/o", "h", "new")], "folder string, base string, text string")
    assert {r.path: r.changed for r in enrich.injected(outputs, sidecars).collect()} == {"/o/x.txt": False, None: None}
    got = {r.path: r.text for r in enrich.injected(outputs, sidecars, ("other", "figures")).collect()}
    body = got["/o/x.txt"].split("```json\n")[1].split("\n```")[0]
    section["figures"][0]["description"], section["figures"][3]["description"] = 'a "picture"', "new"
    assert json.dumps(json.loads(body)) == json.dumps(section) and "1.5" in body
    assert got["/o/x.txt"].startswith("Head\n") and got["/o/x.txt"].endswith("\n```\ntail\n```json\n{ not json }\n```\n")
    counters = enrich.section_counters(outputs.where("path is not null"), sidecars, ("other", "figures")).first()
    assert (counters.first_pass_additions, counters.second_pass_updates, counters.files_not_found, counters.errors_occurred) == (1, 1, 0, 1)


def test_texts_in_tables(spark):
    blocks = spark.createDataFrame([(1, 1, k, *map(float, b)) for k, b in enumerate([(10, 10, 20, 20), (0, 0, 100, 104), (0, 0, 100, 130), (90, 90, 110, 110), (300, 300, 320, 320)])] + [(1, 2, 5, 10.0, 10.0, 20.0, 20.0), (1, 1, 6, None, 1.0, 2.0, 2.0)],
                                   "doc_id long, page_num long, block_idx long, x0 double, y0 double, x1 double, y1 double")
    tables_ = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id long, page_num long, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_idx for r in layout.outside_tables(blocks, tables_).collect()} == {2, 3, 4, 5, 6}
    assert layout.outside_tables(blocks, tables_.limit(0)).count() == 7
