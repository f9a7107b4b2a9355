"""License scan by a positional rare-token index, in DataFrame functions only.

A template is the words of a licence notice with a mandatory key phrase.  The corpus' document
frequencies of all licence words (a table bounded by the templates' vocabulary) rank them by IDF.  A file looks up
its rarest licence words: as a template can stand only where all words of its key phrase do, these are, for each
template, the two rarest words of the key phrase.  Their postings, (template, position), turn places of both words into
starts of the template, which are intersected: only where both agree is the key phrase compared word for word.  A
verified key phrase gives the label, whatever else the corpus holds; the share of the notice's IDF weight that matches at
the place is its score.  Since both words belong to the mandatory phrase, no place is lost by looking up rare words
only, whatever the IDFs are.  Texts are read twice, once for the frequencies.

Everything but the frequencies is computed within a row, so nothing is shuffled and hot words, sources
or copies need no care.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters.  Defined
cases: null and word-less texts have no words, no labels ('') and score 0; repeated rows are judged
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Template(NamedTuple):
    label: str
    notice: str
    key: str  # must stand in the notice


#: Base phrases and labels: fixed by the contract of the query. Each counts wherever its words stand.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
#: Notices of common licences, or their first sentences, as their publishers word them: fixed values.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause license"),
    Template("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0 universal"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-any", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute"),
    Template("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free of charge to any person obtaining a copy"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    Template("proprietary", "proprietary and confidential", "proprietary and confidential"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character outside ASCII whose lower case is an ASCII letter.
_KELVIN = "\u212a"


def words_of(text: Column) -> Column:
    """The words of a text; null gives none. Lower-casing beyond A-Z changes no ASCII word, but for the Kelvin sign."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("\u00e0")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.notice.split()})


def document_frequencies(worded: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """``worded(words)`` -> the number of rows and of rows with each of ``words``; at most ``len(words)`` rows reach the driver."""
    own = F.array_intersect("words", F.array(*map(F.lit, words)))
    counts = worded.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), found


def _at(phrase: Sequence[str], start: Column) -> Column:
    """Whether the words of ``phrase`` stand from ``start`` on."""
    out = F.lit(True)
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get("words", start + k) == w, F.lit(False))
    return out


def _rarest(key: Sequence[str], idf: dict[str, float]) -> list[int]:
    """Places in a key phrase of its two rarest different words (one if it has no more), the rarest first."""
    first = {w: i for i, w in reversed(list(enumerate(key)))}
    return sorted(first.values(), key=lambda i: (-idf[key[i]], i))[:2]


def scan(docs: DataFrame, base: Sequence[Template] = BASE, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places)``.

    ``places``: an array of (label, start, score) of all templates found, base phrases included; ``start`` is where the
    notice would begin, which may lie before the text.
    """
    every = [*base, *templates]
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    n, often = document_frequencies(worded, vocabulary(every))
    idf = {w: math.log((n + 1) / (often.get(w, 0) + 1)) + 1 for w in vocabulary(every)}
    rare = []  # for each template: its rare words, each with its place in the notice; and where its key phrase begins
    for template in every:
        notice, key = template.notice.split(), template.key.split()
        shift = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rare.append(([(key[i], shift + i) for i in _rarest(key, idf)], shift))
    looked_up = sorted({w for words, _ in rare for w, _ in words})
    position = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(looked_up))
    none = F.array().cast("array<struct<w:string,i:int>>")
    looked = worded.withColumn("hits", F.when(F.arrays_overlap("words", F.array(*map(F.lit, looked_up))), position).otherwise(none))
    looked = looked.withColumn("own", F.array_distinct(F.transform("hits", lambda x: x["w"])))

    def places(t: int) -> Column:
        """The places of a template in a file that holds its rare words: their starts intersected, then verified."""
        notice, key = every[t].notice.split(), every[t].key.split()
        words, shift = rare[t]
        total = sum(idf[w] for w in notice)
        starts = [F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["i"] - back) for word, back in words]
        met = starts[0] if len(starts) == 1 else F.array_intersect(*starts)
        found = F.filter(met, lambda start: _at(key, start + shift))

        def place(start: Column) -> Column:
            weight = F.lit(0.0)
            for k, w in enumerate(notice):
                weight = weight + F.when(F.get("words", start + k) == w, F.lit(idf[w] / total)).otherwise(0.0)
            return F.struct(F.lit(t).alias("t"), F.lit(every[t].label).alias("label"), start.alias("start"), F.least(F.lit(1.0), weight).alias("score"))

        here = F.lit(True)
        for word, _ in words:
            here = here & F.array_contains("own", word)
        return F.when(here, F.transform(found, place)).otherwise(F.array().cast("array<struct<t:int,label:string,start:int,score:double>>"))

    looked = looked.withColumn("places", F.when(F.size("hits") > 0, F.flatten(F.array(*map(places, range(len(every)))))).otherwise(F.array().cast("array<struct<t:int,label:string,start:int,score:double>>")))
    placed = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), "places")
    basic = F.transform(F.filter("places", lambda x: x["t"] < len(base)), lambda x: x["start"].cast("long"))
    labels = [F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(chosen, lambda x: x["label"])))) for chosen in (F.filter("places", lambda x: x["t"] < len(base)), F.col("places"))]
    return placed.select(
        "doc_id", "n_words", F.size(basic).cast("long").alias("n_base"), F.array_min(basic).alias("first_word"), F.array_max(basic).alias("last_word"),
        labels[0].alias("base_labels"), labels[1].alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda x: F.struct(x["label"].alias("label"), x["start"].cast("long").alias("start"), x["score"].alias("score"))).alias("places"),
    )


def oracle(base: Sequence[Template] = BASE, templates: Sequence[Template] = TEMPLATES) -> str:
    """SQL for ``scan`` without ``places``, the score rounded: every place of every key phrase, without an index."""
    every = [*base, *templates]
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for t, template in enumerate(every):
        notice, key = template.notice.split(), template.key.split()
        shift = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rows.append(f"({t}, '{template.label}', {str(t < len(base)).lower()}, {shift}, {listed(key)}, {listed(notice)})")
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(replace(coalesce(text, ''), chr(8490), chr(224))), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
templates(t, label, base, shift, key, notice) AS (VALUES {', '.join(rows)}),
idf AS (SELECT w, ln(((SELECT count(*) FROM texts) + 1) / (count(d.r) + 1)) + 1 AS idf FROM (SELECT unnest({listed(vocabulary(every))}) AS w) v LEFT JOIN texts d ON list_contains(d.words, v.w) GROUP BY w),
parts AS (SELECT t, unnest(notice) AS w, unnest(range(0, len(notice))) AS k FROM templates),
places AS (SELECT r, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM texts),
keyed AS (SELECT p.r, t.t, p.i - t.shift AS start FROM places p JOIN templates t ON p.w = t.key[1] JOIN texts d ON d.r = p.r WHERE list_slice(d.words, p.i + 1, p.i + len(t.key)) = t.key),
weighed AS (SELECT k.r, k.t, k.start, least(1.0, sum(CASE WHEN k.start + q.k >= 0 AND d.words[k.start + q.k + 1] = q.w THEN idf ELSE 0 END) / sum(idf)) AS score
  FROM keyed k JOIN parts q USING (t) JOIN idf USING (w) JOIN texts d USING (r) GROUP BY k.r, k.t, k.start),
found AS (SELECT r, label, base, start, score FROM weighed JOIN templates USING (t))
SELECT doc_id, CAST(any_value(len(words)) AS BIGINT) AS n_words, CAST(count(*) FILTER (base) AS BIGINT) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(score), 0), 6) AS score
FROM texts LEFT JOIN found USING (r) GROUP BY r, doc_id"""
