import random
import re

from quirefold.llm import licenses as lic

SCHEMA = "doc_id long, text string, labels string, score string, words int"
LINES = ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "Released under the MIT License.", "under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "general public", "CC", "by", "ÉCC by", "cc\nBY", "all rights", "reserved", "license mit", "LiKense", "PAC\u212aAGE \u212a BY", "cc \u0130by", "apache license version 2 1", "Licensed under cc by 4 0 nc"]


def brute(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base, found = [], set()
        for t in lic.BASE:
            key = t.key.split()
            base += [(k, t.label) for k in range(len(words)) if words[k : k + len(key)] == key]
        for t in lic.TEMPLATES:
            notice, key = t.notice.split(), t.key.split()
            shift = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
            found |= {(t, k - shift) for k in range(len(words)) if words[k : k + len(key)] == key}
        out[i] = (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({b[1] for b in base})), found, words)
    return out


def test_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice([*LINES, "lorem", "the", "of 4 0,", "ünder"]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "--- ..."), (903, "cc by " * 20_000), (904, LINES[3])]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows] + [(904, LINES[3], "", "", 2)], SCHEMA)
    got = lic.scan(df).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    for g in got:
        n, n_base, first, last, base, found, words = want[g.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (n, n_base, first, last, base)
        own = {(p.label, p.start) for p in g.places}
        base_places = {(t.label, k) for t in lic.BASE for k in range(n) if words[k : k + len(t.key.split())] == t.key.split()}
        assert own == {(t.label, start) for t, start in found} | base_places  # every verified key phrase counts, whatever the weights
        assert set(g.labels.split(",")) - {""} == {p.label for p in g.places} and g.labels == ",".join(sorted({p.label for p in g.places}))
        assert 0 <= g.score <= 1 and (g.score > 0) == bool(g.labels)


def test_real_lines_get_their_labels(spark):
    rows = [(i, line) for i, line in enumerate(LINES[:5])]
    got = {g.doc_id: g.labels for g in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "cc-by,cc-by-nc-4.0", 1: "reserved", 2: "mit", 3: "gpl,gpl-3.0", 4: "apache-2.0"}


def test_empty_table_and_plan(spark):
    df = lic.scan(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_labels_do_not_depend_on_other_files(spark):
    """A bare key phrase keeps its label when a third of all rows name it or when its words are rare."""
    bare = [(0, "MIT License"), (1, "see the Mozilla Public License"), (2, "GNU Lesser General Public License")]
    for more in ([], [(10 + k, "released under the MIT License") for k in range(30)], [(10 + k, "MIT, license; mozilla public") for k in range(30)]):
        got = {g.doc_id: g.labels for g in lic.scan(spark.createDataFrame(bare + more, "doc_id long, text string")).collect()}
        assert (got[0], got[1], got[2]) == ("mit", "mpl-2.0", "gpl,lgpl-3.0")


def test_whole_notices_score_higher_than_bare_names(spark):
    whole = next(t for t in lic.TEMPLATES if t.label == "apache-2.0").notice
    got = {g.doc_id: (g.labels, g.score) for g in lic.scan(spark.createDataFrame([(0, whole), (1, "Apache License, Version 2.0"), (2, "x " * 50 + whole[:60])], "doc_id long, text string")).collect()}
    assert all(v[0] == "apache-2.0" for v in got.values()) and got[0][1] == 1.0 > got[2][1] > got[1][1] > 0
