"""Descriptions from sidecar files into the JSON sections of assembled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.functions import text as t

#: Lists that may hold items to describe, in the order in which they are tried.
TARGETS = ("images_with_resolution", "drawings_with_resolution")
_ITEM = "saved string, filename string, description string"


def media_folder(text: Column, stem: Column, suffix: str = "_media") -> Column:
    """The folder that the first twenty lines name, else the stem's."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 20), "\n")
    named = t.strip(F.regexp_extract(head, r"(?m)^Media Directory:([^\n]*)", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.concat(stem, F.lit(suffix)))


def folders(outputs: DataFrame, listing: DataFrame, suffix: str = "_media") -> DataFrame:
    """``outputs(path, text)`` with ``media``: the named folder, else the stem's, whichever of ``listing(folder)`` exists; null for none."""
    stem, parent = t.stem(F.col("path")), t.folder(F.col("path"))
    named = F.explode(F.array(F.struct(F.lit(1).alias("k"), media_folder(F.col("text"), stem, suffix).alias("name")), F.struct(F.lit(2).alias("k"), F.concat(stem, F.lit(suffix)).alias("name"))))
    tried = outputs.select("path", parent.alias("__parent"), named.alias("c")).withColumn("folder", F.concat_ws("/", "__parent", "c.name"))
    there = tried.join(listing.select("folder").distinct(), "folder", "left_semi").groupBy("path").agg(F.min_by("c.name", "c.k").alias("media"))
    return outputs.join(there, "path", "left")


def sections(outputs: DataFrame) -> DataFrame:
    """``outputs(path, text)`` -> ``(path, section, body)``: each fenced JSON section with its number from 0."""
    return outputs.select("path", F.posexplode(t.fences(F.col("text"))).alias("section", "body"))


def parsed(bodies: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """``bodies`` with ``valid`` and, for each target, what is looked at of its items (null where it is missing or no list)."""
    texts, typed = F.from_json("body", "map<string,string>"), F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>")

    def items(k: str) -> Column:
        is_list = F.startswith(F.schema_of_variant(F.element_at(typed, F.lit(k))), F.lit("ARRAY"))
        return F.when(is_list, F.transform(F.from_json(F.element_at(texts, F.lit(k)), "array<string>"), lambda x: F.from_json(x, _ITEM)))

    return bodies.withColumns({"valid": F.try_parse_json("body").isNotNull(), **{k: items(k) for k in targets}})


def eligible(bodies: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """A row for each item that may get a description: saved ones without, and all that have one already.

    Only the first target with such an item is touched in a section.
    """
    both = parsed(bodies, targets).where("valid")
    stacked = None
    for k, target in enumerate(targets):
        one = both.select("path", "section", F.lit(k).alias("target"), F.posexplode(both[target]).alias("item_no", "item"))
        stacked = one if stacked is None else stacked.unionByName(one)
    old = F.coalesce(F.col("item.description"), F.lit(""))
    first = F.col("item.saved").isin("true") & (old == "")
    return stacked.where((first | (old != "")) & (F.coalesce(F.col("item.filename"), F.lit("")) != "")).select(
        "path", "section", "target", "item_no", F.col("item.filename").alias("filename"), old.alias("old_description"))


def described(outputs: DataFrame, sidecars: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """``eligible`` items with ``description`` (null: no sidecar) from ``sidecars(folder, base, text)``: beside the text first, then in its media folder.

    ``outputs(path, text, media)``.
    """
    items = eligible(sections(outputs), targets).join(outputs.select("path", "media"), "path")
    parent = t.folder(F.col("path"))
    base = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1)
    places = F.explode(F.array(F.struct(F.lit(1).alias("k"), parent.alias("folder")), F.struct(F.lit(2).alias("k"), F.concat_ws("/", parent, "media").alias("folder"))))
    key = ["path", "section", "target", "item_no"]
    tried = items.select(*key, base.alias("base"), places.alias("p")).select(*key, "base", F.col("p.k").alias("k"), F.col("p.folder").alias("folder"))
    met = tried.join(sidecars.select("folder", "base", F.col("text").alias("__text")), ["folder", "base"]).groupBy(*key).agg(F.min_by("__text", "k").alias("__text"))
    found = items.join(met, key, "left").withColumn("description", F.when(F.col("__text").isNotNull(), t.clean_sidecar(F.col("__text")))).drop("__text", "media")
    touched = F.min(F.when(F.col("description").isNotNull(), F.col("target"))).over(Window.partitionBy("path", "section"))
    return found.withColumn("__t", touched).where("__t is null or target <= __t").drop("__t")


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    c = F.to_json(F.array(c))
    return c.substr(F.lit(2), F.length(c) - 2)


def _value(text: Column, typed: Column) -> Column:
    """The JSON of a value from its text as ``from_json`` gives it, which has strings without their quotes and null for null."""
    return F.when(F.schema_of_variant(typed) == "STRING", _quoted(text)).otherwise(F.coalesce(text, F.lit("null")))


def _members(body: Column, value, more: tuple[str, ...] = ()) -> Column:
    """``"name": JSON`` of an object's members in their order, and of those of ``more`` that it lacks; ``value(name, JSON)`` may put another JSON in place."""
    texts, typed = F.from_json(body, "map<string,string>"), F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    names = F.json_object_keys(body)
    names = F.concat(names, F.array_except(F.array(*map(F.lit, more)), names)) if more else names
    return F.transform(names, lambda k: F.concat(_quoted(k), F.lit(": " if not more else ":"), value(k, _value(F.element_at(texts, k), F.element_at(typed, k)))))


def _with_description(item: Column, description: Column) -> Column:
    members = _members(item, lambda k, old: F.when(k == "description", _quoted(description)).otherwise(old), ("description",))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def injected(outputs: DataFrame, sidecars: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """``outputs`` with new ``text``: each section's items carry their descriptions; other sections and texts stay byte for byte.

    Rewritten sections keep all members and items in their order, each value as it was written; ``changed`` tells whether a text was rewritten.
    """
    new = described(outputs, sidecars, targets).where("description is not null")
    lists = new.groupBy("path", "section").agg(
        F.first("target").alias("__target"), F.map_from_entries(F.collect_list(F.struct(F.col("item_no").cast("int").alias("item_no"), "description"))).alias("__new"))
    joined = sections(outputs).join(lists, ["path", "section"]).withColumn("__key", F.get(F.array(*map(F.lit, targets)), F.col("__target")))

    def items(old: Column) -> Column:
        texts, typed = F.from_json(old, "array<string>"), F.try_variant_get(F.try_parse_json(old), "$", "array<variant>")
        described_ones = F.transform(texts, lambda x, i: F.when(F.map_contains_key("__new", i), _with_description(x, F.element_at("__new", i))).otherwise(_value(x, F.get(typed, i))))
        return F.concat(F.lit("["), F.array_join(described_ones, ","), F.lit("]"))

    parts = _members(F.col("body"), lambda k, old: F.when(k == F.col("__key"), items(old)).otherwise(old))
    body = F.concat(F.lit("{\n  "), F.array_join(parts, ",\n  "), F.lit("\n}"))
    rewritten = joined.select("path", "section", body.alias("__body")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("section", "__body"))).alias("__bodies"))
    pieces = F.split("text", "(?s)```json\\n.*?\\n```", -1)
    bodies = t.fences(F.col("text"))
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(bodies), F.concat(F.lit("```json\n"), F.coalesce(F.element_at("__bodies", i), F.get(bodies, i)), F.lit("\n```"))).otherwise(""))), "")
    out = outputs.join(rewritten, "path", "left")
    return out.withColumn("__new", F.when(F.col("__bodies").isNotNull(), text).otherwise(F.col("text"))).withColumn("changed", F.col("__new") != F.col("text")).withColumn("text", F.col("__new")).drop("__new", "__bodies")


def section_counters(outputs: DataFrame, sidecars: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """Per text: sections seen, descriptions added and updated, sidecars missing, sections that are no JSON."""
    seen = parsed(sections(outputs)).groupBy("path").agg(F.count(F.lit(1)).alias("json_sections_processed"), F.count_if(~F.col("valid")).alias("errors_occurred"))
    got = F.col("description").isNotNull()
    items = described(outputs, sidecars, targets).groupBy("path").agg(
        F.count_if(got & (F.col("old_description") == "")).alias("first_pass_additions"), F.count_if(got & (F.col("old_description") != "")).alias("second_pass_updates"), F.count_if(~got).alias("files_not_found"))
    out = outputs.select("path").join(seen, "path", "left").join(items, "path", "left")
    return out.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("json_sections_processed", "first_pass_additions", "second_pass_updates", "files_not_found", "errors_occurred")))


def process_folder(outputs: DataFrame, listing: DataFrame, sidecars: DataFrame, require_media: bool = True, suffix: str = "_media", targets: tuple[str, ...] = TARGETS) -> tuple[DataFrame, DataFrame]:
    """All texts of a folder: those whose text changed, and the counters of every text with ``skipped`` for want of a media folder."""
    placed = folders(outputs, listing, suffix)
    active = placed.where("media is not null") if require_media else placed.withColumn("media", F.coalesce("media", F.concat(t.stem(F.col("path")), F.lit(suffix))))
    counters = section_counters(active, sidecars, targets).withColumn("skipped", F.lit(0).cast("long"))
    if require_media:
        none = [F.lit(0).cast("long").alias(c) for c in counters.columns[1:-1]]
        counters = counters.unionByName(placed.where("media is null").select("path", *none, F.lit(1).cast("long").alias("skipped")))
    return injected(active, sidecars, targets).where("changed").select("path", "text"), counters


def totals(counters: DataFrame) -> DataFrame:
    """Sums over texts, or over folders of such sums."""
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters.columns if c != "path"))
