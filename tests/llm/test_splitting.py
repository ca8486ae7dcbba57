"""Pieces against a direct reading of the rule."""

import re

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from seamline.llm.splitting import pieces, split_records


def brute(text, markdown, limit, overlap):
    """Every position is tried, the rule is spelt out."""

    def line_start(e):
        return e == 0 or text[e - 1] == "\n"

    def section(e):
        rest = text[e : e + 20]
        return line_start(e) and bool(re.match(r"#{1,6} ", rest) if markdown else rest.startswith(("def ", "class ", "async def ", "function ", "func ")))

    def after_blank(e):
        if e == 0 or text[e - 1] != "\n":
            return False
        before = text.rfind("\n", 0, e - 1) + 1
        return not text[before : e - 1].strip(" \t\r")

    classes = (section, after_blank, line_start, lambda e: e > 0 and text[e - 1] == " ")
    start, out = 0, []
    while len(text) - start > limit:
        span = range(start + limit, start + limit // 2 - 1, -1)
        end = next((e for c in classes for e in span if c(e)), start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))] if text else []


@given(st.text(alphabet="ab \n\t\r#dé😀", max_size=400), st.booleans())
@settings(max_examples=200, deadline=None)
def test_rule(text, markdown):
    text = text.replace("d", "def ").replace("#", "\n## ")
    assert pieces(text, markdown, 40, 7) == brute(text, markdown, 40, 7)


def test_round_trip_and_long_text():
    text = "".join(f"line {i}\n" if i % 9 else "\n" for i in range(200_000))
    spans = pieces(text, False)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b == c + 200 for (_, b), (c, _) in zip(spans, spans[1:]))
    assert text[: spans[0][1]] + "".join(text[a + 200 : b] for a, b in spans[1:]) == text
    assert all(1000 <= b - a <= 2000 for a, b in spans[:-1])


def test_limits():
    assert pieces("", True) == [] and pieces("x" * 2000, True) == [(0, 2000)] and pieces("x" * 2001, True) == [(0, 2000), (1800, 2001)]
    with pytest.raises(ValueError):
        pieces("x", True, 100, 60)


def test_table(spark):
    long = "# T\n" + "word " * 1000
    data = [(1, "a.py", long, 7), (1, "a.py", long, 8), (2, "B.MD", long, 7), (3, None, long, 7), (4, "x.py", None, 7), (5, "x.py", " " * 5000, 7), (6, "x.py", "", 7), (None, "x.py", long, 7), (7, "x.py", "y" * 2000, 7)]
    df = spark.createDataFrame(data, "file_id bigint, path string, content string, start_index int")
    got = split_records(df, "file_id", "content", "path")
    assert {r.id for r in got.collect()} == {1, 2, 3}
    assert [tuple(r) for r in sorted(got.where("id = 2").select("start_index", "end_index").collect())] == brute(long, True, 2000, 200)
    assert all(r.piece == long[r.start_index : r.end_index] for r in got.collect())
    assert split_records(df.where("false"), "file_id", "content", "path").count() == 0
    assert rows(got.where("id = 1"), "start_index")[0] == (0,)
