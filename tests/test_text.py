"""Literal edge cases and properties of the text functions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quirefold.functions import text as t


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
        return [r.v for r in df.select("i", function(F.col("c")).alias("v")).orderBy("i").collect()]

    return run


def test_hyphen_fix(apply):
    cases = {"a-\nb-\nc": ("ab- c", 1), "foo -\nbar\n": ("foobar ", 1), "x-\n\ny": ("x-  y", 0), "last-": ("last-", 0), "-\nz": ("z", 1), "p--\nq": ("p-q", 1), "": ("", 0)}
    assert list(zip(apply(t.fix_hyphens, cases), apply(t.count_hyphens, cases))) == list(cases.values())


def test_words_and_characters(apply):
    cases = {"": 0, "a''b": 1, "'hello'": 1, "rock 'n' roll": 3, "naïve_1 x2": 2, "12 34": 2, "é": 1, None: 0, "''": 0}
    assert apply(t.count_words, cases) == list(cases.values())
    assert apply(t.count_characters, ["a😀é", None, ""]) == [3, 0, 0]
    assert apply(t.count_visible, [" a\tb c　", None, "\u0085\x1c"]) == [3, 0, 0]


def test_nonprintable(apply):
    assert apply(t.remove_nonprintable, ["a\r\n\r\nb", "a\tb", "\x00a", "a\x01\x0bb", "a\x7fb", "a   b", "   x "]) == ["a b", "a b", "\x00a", "ab", "a\x7fb", "a b", "x"]


def test_spaces_descriptions_and_ratio(apply):
    assert apply(t.normalise_spaces, ["a­b​c d e f g"]) == ["abc d e f g"]
    assert apply(t.clean_sidecar, ["Start x END", "weekend éend _end", "start end", None]) == ["x", "weekend éend _end", "No description available", "No description available"]
    assert apply(t.clean_description, [" **a** # b*"]) == ["a  b*"]
    assert apply(t.european_ratio, ["", "abc1", "中文ab", "a b!", None]) == [0.0, 1.0, 0.5, 0.5, 0.0]
    assert apply(t.is_european, ["中文ab", "abc"]) == [False, True]


def test_paths_and_times(apply):
    assert apply(t.stem, ["/a/b/c.tar.gz", "d.pdf", "/x/noext"]) == ["c.tar", "d", "noext"]
    assert apply(t.base_name, ["/a/b/c.txt", "d"]) == ["c.txt", "d"] and apply(t.folder, ["/a/b/c.txt", "d"]) == ["/a/b", ""]
    assert apply(lambda c: t.format_seconds(c.cast("long")), ["0", "59", "60", "3599", "3600", "7322"]) == ["0s", "59s", "1m 0s", "59m 59s", "1h 0m", "2h 2m"]


def test_fences(apply):
    text = 'x\n```json\n{"a": 1}\n```\ny\n```json\n{\n```\n'
    assert apply(t.fences, [text, "none", "```json\n```"]) == [['{"a": 1}', "{"], [], []]


def pairs(text):
    """The rule line by line."""
    lines = [line.strip() for line in text.split("\n")]
    out, n, i = [], 0, 0
    while i < len(lines):
        if lines[i].endswith("-") and i + 1 < len(lines) and lines[i + 1]:
            out.append(lines[i][:-1].rstrip() + lines[i + 1])
            n, i = n + 1, i + 2
        else:
            out.append(lines[i])
            i += 1
    return " ".join(out), n


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab- \n\t é", max_size=25), min_size=20, max_size=40))
def test_hyphen_rule_line_by_line(apply, texts):
    assert list(zip(apply(t.fix_hyphens, texts), apply(t.count_hyphens, texts))) == [pairs(x) for x in texts]


def test_word_rule_equals_python(apply):
    texts = ["it's a_b 'x' — naïve Ünd 'tis o''clock", "über-all 3.14 a'b'c ''", "'a 'b'"]
    assert apply(t.count_words, texts) == [len(re.findall(r"\b[\w']+\b", x)) for x in texts]
