"""Detected table grids: cleaning, usefulness, limits, headline, headers and rows.

``tables(doc_id, page_num, table_num, x0..y1, cells array<array<string>>)``.  All structuring is within a row of
the table list, by higher-order functions; a missing cell reads ``None``, as it is printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.config import LayoutConfig
from quirefold.functions import geometry as g, text as t

PAGE = ["doc_id", "page_num"]
#: Placeholders: fixed sets. For empty rows and for blank cells case is ignored, for an empty corner it is not.
EMPTY_ROW = ("", "null", "none", "nan", "-", "_")
BLANK = ("", "null", "none")
CORNER = ("", "null", "none", "-", "_")
#: What JSON escapes in a string, and what stands for bytes that are no text.
ESCAPED = '["\\\\\\x00-\\x1f\ufffd]'


def clean_cells(cells: Column, fix_hyphens: bool = True) -> Column:
    def clean(c: Column) -> Column:
        return t.remove_nonprintable(t.fix_hyphens(c) if fix_hyphens else c)

    return F.transform(cells, lambda r: F.transform(r, clean))


def count_fixes(cells: Column) -> Column:
    return F.aggregate(F.flatten(cells), F.lit(0).cast("long"), lambda n, c: n + F.coalesce(t.count_hyphens(c), F.lit(0).cast("long")))


def _shown(c: Column) -> Column:
    return t.strip(F.coalesce(c, F.lit("None")))


def _blank(c: Column) -> Column:
    return F.lower(_shown(c)).isin(*BLANK)


def is_useful(cells: Column) -> Column:
    """Rows, enough of them filled, at least three cells that say something, and not one row of several columns."""
    size = F.coalesce(F.size(cells), F.lit(0))
    empty = F.size(F.filter(cells, lambda r: ~F.exists(r, lambda c: ~F.lower(t.strip(F.coalesce(c, F.lit("")))).isin(*EMPTY_ROW))))
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda c: ~_blank(c)))
    lone = (size == 1) & (F.size(F.get(cells, F.lit(0))) > 1)
    return F.coalesce((size > 0) & (F.size(flat) > 0) & ~(g.ratio(empty, size) > 0.75) & (filled >= 3) & ~lone, F.lit(False))


def limited(tables: DataFrame, pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``tables`` with ``number`` among all detected and ``status``: margin, limit, useless or kept.

    The limit counts kept tables and is asked after the margin and before usefulness.
    """
    order = Window.partitionBy(*PAGE).orderBy("table_num")
    inside = ~g.center_in_margin(g.box(), F.col("width"), F.col("height"), config)
    judged = tables.join(pages, PAGE).withColumns({"__in": inside, "__useful": is_useful(F.col("cells")), "number": F.row_number().over(order)})
    before = F.coalesce(F.count_if(F.col("__in") & F.col("__useful")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.lit(config.max_items_per_page > 0) & (before >= config.max_items_per_page)
    status = F.when(~F.col("__in"), "margin").when(over, "limit").when(~F.col("__useful"), "useless").otherwise("kept")
    return judged.withColumn("status", status).drop("__in", "__useful", "width", "height")


def _single(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: ~F.lower(c).isin(*BLANK))) == 1


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is not expanded where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def structured(tables: DataFrame) -> DataFrame:
    """``tables(.., cells)`` with headline, description, headers, corner (first header cell empty) and body rows.

    ``standard_rows``: array<map<header, value>>; ``corner_rows``: array<struct<label, cells: map<header, value>>>.
    """
    shown = tables.withColumn("__r", F.transform(F.coalesce("cells", F.array().cast("array<array<string>>")), lambda r: F.transform(r, _shown)))
    first = F.get("__r", F.lit(0))
    head = shown.withColumn("__h", F.coalesce(_single(first), F.lit(False)))
    head = head.withColumn("headline", F.when(F.col("__h"), F.get(first, F.lit(0)))).withColumn("__r", F.when(F.col("__h"), F.slice("__r", 2, F.greatest(F.size("__r") - 1, F.lit(0)))).otherwise(F.col("__r")))
    last = F.element_at("__r", -1)
    tail = head.withColumn("__d", F.when(F.size("__r") > 1, _single(last)).otherwise(False))
    tail = tail.withColumn("description", F.when(F.col("__d"), F.get(last, F.lit(0)))).withColumn("__r", F.when(F.col("__d"), F.slice("__r", 1, F.size("__r") - 1)).otherwise(F.col("__r")))
    top = F.coalesce(F.get("__r", F.lit(0)), F.array().cast("array<string>"))
    corner = (F.size(top) >= 2) & F.coalesce(F.get(top, F.lit(0)).isin(*CORNER), F.lit(False))
    named = tail.withColumns({"has_header": F.size("__r") > 0, "corner": corner})
    names = F.filter(F.when(F.col("corner"), F.slice(top, 2, F.greatest(F.size(top) - 1, F.lit(0)))).otherwise(top), lambda c: ~F.lower(c).isin(*BLANK))
    named = named.withColumn("__n", names)

    def unique(n: Column) -> Column:
        def numbered(h: Column, i: Column) -> Column:
            k = F.size(F.filter(F.slice(n, 1, i), lambda x: x == h))
            return F.when(k == 0, h).otherwise(F.concat(h, F.lit("_"), k.cast("string")))

        return F.transform(n, numbered)

    named = named.withColumn("headers", _once(F.col("__n"), unique)).withColumn("__b", F.slice("__r", 2, F.greatest(F.size("__r") - 1, F.lit(0))))

    named = named.withColumn("__u", F.size(F.array_distinct("headers")) == F.size("headers"))

    def entries(table: Column, row: Column, shift: int) -> Column:
        """Header and value of the cells that say something; a repeated header keeps its first place and last value."""
        headers = table["h"]
        says = lambda v: v.isNotNull() & ~F.lower(v).isin(*BLANK)
        each = F.map_filter(F.map_from_arrays(headers, F.transform(headers, lambda h, j: F.get(row, j + shift))), lambda k, v: says(v))
        found = F.filter(F.transform(headers, lambda h, j: F.struct(h.alias("key"), F.get(row, j + shift).alias("value"))), lambda e: says(e["value"]))
        last = lambda es: lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"]
        repeated = lambda es: _once(F.array_distinct(F.transform(es, lambda e: e["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, last(es))))
        return F.when(table["u"], each).otherwise(_once(found, repeated))

    by_label = F.col("corner") & (F.size("headers") > 0)
    body = F.struct(F.col("headers").alias("h"), F.col("__b").alias("b"), F.col("__u").alias("u"))
    standard = F.filter(_once(body, lambda s: F.transform(s["b"], lambda r: entries(s, r, 0))), lambda m: F.size(m) > 0)

    def labels(s: Column) -> Column:
        said = F.filter(s["b"], lambda r: ~F.lower(F.coalesce(F.get(r, F.lit(0)), F.lit(""))).isin(*BLANK))
        return F.transform(said, lambda r: F.struct(F.get(r, F.lit(0)).alias("label"), entries(s, r, 1).alias("cells")))

    labelled = F.filter(_once(body, labels), lambda x: F.size(x["cells"]) > 0)
    nothing = F.array().cast("array<struct<label:string,cells:map<string,string>>>")
    out = named.withColumn("standard_rows", F.when(by_label, F.array().cast("array<map<string,string>>")).otherwise(standard)).withColumn("corner_rows", F.when(by_label, labelled).otherwise(nothing))
    kind = F.when(~F.col("has_header") & F.col("headline").isNull(), "no_data").when(F.coalesce("headline", F.lit("")) != "", "headline").otherwise("standard")
    return out.withColumns({"type": kind, "row_count": (F.size("standard_rows") + F.size("corner_rows")).cast("long")}).drop("__r", "__h", "__d", "__n", "__b", "__u")


def counted_text(structured_tables: DataFrame) -> DataFrame:
    """``structured`` with ``word_count`` and ``char_count`` of headline, description, headers and rows (keys count in each row)."""
    flat = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"])))
    rows = F.flatten(F.transform("standard_rows", flat))
    corners = F.flatten(F.transform("corner_rows", lambda x: F.concat(F.array(x["label"]), flat(x["cells"]))))
    text = F.concat_ws(" ", "headline", "description", "headers", rows, corners)
    return structured_tables.withColumn("__t", text).withColumns({"word_count": t.count_words(F.col("__t")), "char_count": t.count_characters(F.col("__t"))}).drop("__t")


def has_lines(items: Column) -> Column:
    """Whether a page's vector items (array of kinds) can rule a table: a line or a rectangle."""
    return F.coalesce(F.exists(items, lambda k: k.isin("l", "re")), F.lit(False))


def _quoted(c: Column) -> Column:
    """A string as JSON; null as null."""
    return _once(F.to_json(F.array(c)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _indented(items: Column, depth: int, brackets: str = "[]") -> Column:
    """JSON texts one a line, two spaces for each level; nothing between the brackets if there are none."""
    pad = "\n" + "  " * (depth + 1)
    return _once(items, lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit(brackets[0] + pad), F.array_join(xs, f",{pad}"), F.lit("\n" + "  " * depth + brackets[1]))).otherwise(brackets))


def _record(cells: Column, depth: int) -> Column:
    """A row as an object. One search tells whether any of its strings has something to escape (or is null, or no text); if none has, they are only joined."""
    pad, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    odd = F.rlike(F.array_join(F.concat(F.map_keys(cells), F.map_values(cells)), "", "\ufffd"), F.lit(ESCAPED))
    members = F.zip_with(F.map_keys(cells), F.map_values(cells), lambda k, v: F.array_join(F.array(k, v), '": "'))
    plain = F.concat(F.lit(f'{{{pad}"'), F.array_join(members, f'",{pad}"'), F.lit(f'"{end}}}'))
    escaped = _indented(F.transform(F.map_entries(cells), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), _quoted(e["value"]))), depth, "{}")
    return F.when((F.size(cells) == 0) | odd, escaped).otherwise(plain)


def section_text(structured_tables: DataFrame) -> DataFrame:
    """``structured`` with ``section``: the summary lines and the JSON record of each table, eight keys, indented by two; a row under a label is an object in an object."""
    labelled = F.transform("corner_rows", lambda x: F.concat(F.lit("{\n      "), _quoted(x["label"]), F.lit(": "), _record(x["cells"], 3), F.lit("\n    }")))
    rows = F.concat(F.transform("standard_rows", lambda m: _record(m, 2)), labelled)
    fields = {
        "table_number": F.col("number").cast("string"), "page_number": F.col("page_num").cast("string"), "type": _quoted(F.col("type")), "headline": _quoted(F.col("headline")),
        "description": _quoted(F.col("description")), "column_headers": _indented(F.transform("headers", _quoted), 1), "data_rows_count": F.col("row_count").cast("string"), "data_rows": _indented(rows, 1),
    }
    record = _indented(F.array(*(F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items())), 0, "{}")
    head = F.format_string("\n\nTABLE %d ON PAGE %d\n\nType: %s\nHas Header: %s\nData Rows: %d\n", "number", "page_num", "type", F.when(F.col("has_header"), "True").otherwise("False"), "row_count")
    line = F.when(F.coalesce("headline", F.lit("")) != "", F.format_string("Headline: %s\n", "headline")).otherwise("")
    return structured_tables.withColumn("section", F.concat(head, line, F.lit("```json\n"), record, F.lit("\n```\n\n")))
