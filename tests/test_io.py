"""Sources, sinks, the describing run, and streams."""

import contextlib
import datetime

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirefold.operators import describe, progress
from quirefold.sources import files
from quirefold.streaming import progress as stream


# Workers cannot import this module: its readers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FakeTable:
    bbox = (0, 1, 2, 3)

    def extract(self):
        return [["a", None], ["b", 1]]


class FakePage:
    class rect:
        width, height = 100.0, 200.0

    def __init__(self, n):
        self.n = n

    def get_image_info(self, xrefs):
        return [{"xref": 9, "bbox": (0, 0, 5, 5), "width": 50, "height": 60}]

    def get_drawings(self):
        return [{"rect": (1, 1, 2, 2), "items": [("l",), ("c",)]}] if self.n == 1 else []

    def cluster_drawings(self):
        return [(0, 0, 9, 9)]

    def find_tables(self):
        return [FakeTable()]

    def get_text(self, kind):
        if self.n == 2:
            raise ValueError("damaged page")
        return [(0, 1, 2, 3, f"page {self.n}", 0, 0)]


class FakeDocument:
    metadata = {"title": "t", "author": "", "none": None}
    is_repaired = True

    def __init__(self, content):
        if content == b"broken":
            raise ValueError("cannot open")
        self.needs_pass = content == b"locked"

    def __len__(self):
        return 3

    def __getitem__(self, i):
        return FakePage(i + 1)


def fake_open(content):
    return contextlib.nullcontext(FakeDocument(content))


def test_listing_and_validation(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.pdf": b"fine", "sub/B.PDF": b"locked", "c.Pdf": b"broken", "d.txt": b"no", ".hidden.pdf": b"fine"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.listed(spark, str(tmp_path), "pdf")
    assert found.count() == 3
    known = found.where(F.col("path").endswith("a.pdf"))
    assert files.new_paths(found.unionByName(found), known).count() == 2
    got = {r.filename: r for r in files.validated(found, fake_open).collect()}
    assert got["a"].valid and got["a"].page_count == 3 and got["a"].metadata == {"title": "t"} and got["a"].is_repaired
    assert not got["B"].valid and got["B"].is_protected and not got["c"].valid and got["c"].reason == "cannot open"
    pages = found.where(F.col("path").endswith("a.pdf")).withColumns({"first_page": F.lit(1), "last_page": F.lit(3)})
    assert [(r.page_num, r.text) for r in files.blocks(pages, fake_open).orderBy("page_num").collect()] == [(1, "page 1"), (2, None), (3, "page 3")]


def test_page_scans_and_saving(spark):
    f = spark.createDataFrame([("p", b"fine", 1, 2)], "path string, content binary, first_page int, last_page int")
    assert [(r.page_num, r.xref, r.px_width) for r in files.images_on_pages(f, fake_open).collect()] == [(1, 9, 50), (2, 9, 50)]
    assert [(r.page_num, r.kinds) for r in files.drawings_on_pages(f, fake_open).collect()] == [(1, "l,c")]
    assert [r.x1 for r in files.drawing_clusters_on_pages(f, fake_open).collect()] == [9.0, 9.0]
    assert [(r.page_num, r.table_num, r.cells) for r in files.tables_on_pages(f, fake_open).collect()] == [(1, 1, [["a", None], ["b", "1"]])]

    def render(row):
        if row["idx"] == 2:
            raise OSError("disk full")

    two = spark.createDataFrame([("p", b"broken", 1, 2), ("q", b"fine", 1, 1)], "path string, content binary, first_page int, last_page int")
    assert [(r.doc_id, r.page_num, r.xref, r.error) for r in files.images_on_pages(two, fake_open).orderBy("doc_id").collect()] == [("p", 1, None, "cannot open"), ("q", 1, 9, None)]
    items = spark.createDataFrame([(1,), (2,)], "idx int")
    assert [(r.saved, r.save_error) for r in files.saved_media(items, render).orderBy("idx").collect()] == [(True, None), (False, "disk full")]


def test_file_states(spark):
    state = spark.createDataFrame([("Ready", 3), ("Error", None), ("Done", 4)], "status string, page_count int")
    assert progress.eligible_files(state).count() == 2 and tuple(progress.scan_totals(state).first()) == (3, 7)
    events = spark.createDataFrame([("a", 1, 1, 1, 4, 0, 0), ("a", 2, 2, 2, 4, 1, 0), ("b", 1, 1, 3, 6, 0, 2)], "file string, ts int, seq int, pages_done int, total_pages int, images int, drawings int")
    assert tuple(progress.progress_totals(events).first()) == (5, 10, 1, 2, 50)


def test_pdf_reader_is_optional():
    with pytest.raises(RuntimeError, match="optional"):
        files._open(b"x")


def test_documents_out_and_in(spark, tmp_path):
    docs = spark.createDataFrame([("a", "line 1\nline 2"), ("b", "x\n")], "filename string, text string")
    files.write_documents(docs, str(tmp_path / "out"))
    files.write_documents(docs.where("filename = 'a'").withColumn("text", F.lit("new")), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert {(r.filename, r.value) for r in back.collect()} == {("a", "new\n"), ("b", "x\n")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.TXT").write_text("é\n")
    (tmp_path / "t" / "two.md").write_text("x")
    assert [(r.path.rsplit("/")[-1], r.text) for r in files.texts(spark, str(tmp_path / "t")).collect()] == [("one.TXT", "é\n")]
    assert files.sidecars(spark, str(tmp_path / "t")).first().base == "one"
    before = spark.createDataFrame([("p", "same"), ("q", "old")], "path string, text string")
    after = spark.createDataFrame([("p", "same"), ("q", "new"), ("r", "first")], "path string, text string")
    assert {r.path for r in files.changed_only(after, before).collect()} == {"q", "r"}


def test_retries(spark):
    lengths = {"a": [99, 100], "b": [3500], "c": [3501, 99, 3501], "d": [None, 5, 6], "e": [1, 2, 300]}
    rows = [(k, i + 1, None if n is None else "x" * n) for k, v in lengths.items() for i, n in enumerate(v)]
    best = progress.best_attempt(spark.createDataFrame(rows, "image string, attempt int, description string"))
    got = {r.image: (r.attempts, r.outcome, len(r.description or "")) for r in best.collect()}
    assert got == {"a": (2, "valid", 100), "b": (1, "valid", 3500), "c": (3, "long", 0), "d": (3, "short", 0), "e": (3, "valid", 300)}
    total = progress.run_summary(best).first()
    assert (total.processed, total.valid, total.short, total.long, total.failed) == (5, 3, 1, 1, ["c", "d"])
    images = spark.createDataFrame([("i", b"1"), ("j", b"2")], "image string, content binary")
    made = describe.attempts(images)
    assert made.collect() == describe.attempts(images.repartition(2)).orderBy("image", "attempt").collect() or made.count() >= 2
    assert images.select(describe.data_uri(F.col("content")).alias("u")).first().u == "data:image/jpeg;base64,MQ=="


def moments(*seconds):
    return [(k, "f", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for k, s in enumerate(seconds)]


def test_stream_of_events_equals_batch(spark, tmp_path):
    rows = moments(0, 0.05, 0.1, 0.15, 0.2, 0.31, 0.32, 5)
    schema = "id long, file string, ts timestamp"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in/*"))
    batch = {r.id for r in progress.throttled(whole, "file", "ts", "id", 0.1).collect()}
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("throttled", stream.throttled(source, "file", "ts", "id", 0.1), "append"), ("totals", stream.totals(source.withColumnRenamed("file", "doc_id"), "id"), "complete"), ("windows", stream.windowed(source, "ts", "1 second", "1 second", "file"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.id for r in spark.table("throttled").collect()} == batch == {0, 2, 4, 5, 7}
    assert spark.table("totals").first().pages_done == 8
    assert spark.table("windows").count() >= 2
