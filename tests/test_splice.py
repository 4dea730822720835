"""Edits that keep a file's layout, and entries that are never closed."""

import random

import pytest

from quillspark.sources import bibtex as B

TEXT = """% head, é
@article{a1,
  title = {One, {Two}},  % why
  year=1999
}
text between @ entries
@book{b2, title = "Q, {"}", note = {x}, note = {y},}
@misc{c3,}
"""


def test_nothing_else_changes():
    assert B.spliced(TEXT, {}) == TEXT == B.spliced(TEXT, {"absent": {"title": "x"}}) == B.spliced(TEXT, {"a1": {"absent": None}})
    assert B.spliced(TEXT, {"a1": {"year": "2001"}}) == TEXT.replace("year=1999", "year={2001}")
    assert B.spliced(TEXT, {"a1": {"title": "N"}}) == TEXT.replace("{One, {Two}}", "{N}")
    assert B.spliced(TEXT, {"a1": {"title": None}}) == TEXT.replace("title = {One, {Two}},  ", "")
    assert B.spliced(TEXT, {"a1": {"year": None}}) == TEXT.replace("  year=1999\n", "")
    assert B.spliced(TEXT, {"a1": {"doi": "10.1/x"}}) == TEXT.replace("year=1999", "year=1999,\n  doi = {10.1/x}")
    assert B.spliced(TEXT, {"b2": {"title": "N"}}) == TEXT.replace('"Q, {"}"', '"N"')
    assert B.spliced(TEXT, {"b2": {"note": "z"}}) == TEXT.replace("{y}", "{z}")
    assert B.spliced(TEXT, {"b2": {"note": None}}) == TEXT.replace("note = {x}, note = {y},", "")
    assert B.spliced(TEXT, {"c3": {"year": "1"}}) == TEXT.replace("@misc{c3,}", "@misc{c3,\n  year = {1},}")


def test_edits_are_read_back_as_made():
    r = random.Random(5)
    for _ in range(300):
        edits = {k: {n: r.choice([None, "v", "{A} b"]) for n in r.sample(["title", "year", "note", "doi", "url"], r.randint(1, 4))} for k in r.sample(["a1", "b2", "c3"], 2)}
        before, after = ({k: dict(B.fields(c)) for _, k, c in B.scan(t)} for t in (TEXT, B.spliced(TEXT, edits)))
        for k, e in edits.items():
            before[k] = {n: v for n, v in (before[k] | e).items() if v is not None}
        assert after == before, edits


def test_an_unclosed_entry_keeps_to_itself():
    got = [(k, dict(B.fields(c))) for _, k, c in B.scan("@article{a, title = {x\n@article{b, title = {y}}\n  @misc{c, year = 2}\n")]
    assert [k for k, _ in got] == ["a", "b", "c"] and got[1][1] == {"title": "y"} and got[2][1] == {"year": "2"}


def test_splice_tables(spark):
    files = spark.createDataFrame([("f", TEXT), ("g", TEXT), ("h", None), ("i", "")], "file string, content string")
    rows = [("f", "a1", "YEAR", "1"), ("f", "a1", "year", "2"), ("f", "a1", "year", None), ("h", "a1", "year", "3"), ("z", "a1", "year", "4"), (None, "a1", "year", "5"), ("g", None, "year", "6"), ("g", "a1", None, "7")]
    edits = spark.createDataFrame([(*e, "clash") for e in rows], "file string, key string, name string, value string, content string")
    got = {x.file: x.content for x in B.splice_fields(files, edits).collect()}
    assert got == {"f": TEXT.replace("year=1999", "year={2}"), "g": TEXT, "h": None, "i": ""}
    assert B.splice_fields(files, edits.limit(0)).count() == 4 and B.splice_fields(files.limit(0), edits).count() == 0
    bad = spark.createDataFrame([("f", "a1", "year", "}{")], "file string, key string, name string, value string")
    with pytest.raises(Exception, match="unbalanced"):
        B.splice_fields(files, bad).collect()
