"""Table records: each part of a record is made once for each table, and plain and odd strings give the same JSON."""

import json
import re

from pyspark.sql import functions as F

from quirefold.operators import tables
from quirefold.plans import fixtures as fx

SCHEMA = "doc_id string, page_num int, number int, cells array<array<string>>"


def test_a_record_makes_each_part_once(spark, sf_dir):
    made = tables.section_text(tables.structured(fx.grids(spark, sf_dir).withColumn("number", F.lit(1)))).select("section")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    record = plan[: plan.index("AS section#")]
    for rows in ("standard_rows", "corner_rows", "headers"):
        assert len(re.findall(rf"transform\({rows}#", record)) == 1, rows
    assert record.count("StructsToJsonEvaluator") <= 12


def test_wide_rows(spark):
    cells = [[f"h{i}" for i in range(1500)]] + [[f"v{i}" for i in range(1500)] for _ in range(3)]
    made = tables.structured(spark.createDataFrame([("d", 1, 1, cells)], SCHEMA)).first()
    assert made.standard_rows == [dict(zip(*cells[:2]))] * 3


def test_odd_strings_and_repeated_headers(spark):
    odd = ['q"u', "back\\slash", "nl\nx", "tab\tx", "a\x01b", '": "', "y z", "\U0001f600", "\\n", "x�", "\x7f"]
    rows = [["Size", "Size", "Size_1", 'k"'], *([x, "b", "c", x] for x in odd), ["p", "q", "r", "s"], ["t", "none", "", "u"]]
    corner = [["-", "A", 'k"'], *([x, "b", x] for x in odd), ["p", "q", "r"], ["t", "u", "v"]]
    tabs = spark.createDataFrame([("d", 2, 1, rows), ("d", 3, 1, corner)], SCHEMA)
    first, second = tables.section_text(tables.structured(tabs)).orderBy("page_num").collect()
    expected = [{"Size": x, "Size_1": "c", 'k"': x} for x in odd] + [{"Size": "p", "Size_1": "r", 'k"': "s"}, {"Size": "t", 'k"': "u"}]
    labelled = [{x: {"A": "b", 'k"': x}} for x in odd] + [{"p": {"A": "q", 'k"': "r"}}, {"t": {"A": "u", 'k"': "v"}}]
    for made, data in ((first, expected), (second, labelled)):
        text = re.search(r"(?s)```json\n(.*)\n```", made.section)[1]
        record = json.loads(text)
        assert record["data_rows"] == data and record["data_rows_count"] == len(data)
        assert text == json.dumps(record, indent=2, ensure_ascii=False)
