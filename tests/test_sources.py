import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import bibtex as B
from quillspark.sources import payloads as P

BIB = """% a comment @article{no, title = {x}}
@Article{smith-2020:a.b,
  author = {Smith, J. and {The {Deep} Group}},
  title = "Quoted {"}inner{"} text",
  booktitle = {A   book
     title},
  year = 2021,
  note = {50% of it \\{ brace},
}
@misc(par, title = {In (round) ones}, doi = {10.1/x})
@book{last, title={Unclosed"""


def test_scan_keeps_what_naive_scanners_lose():
    got = list(B.scan(BIB))
    assert [(t, k) for t, k, _ in got] == [("article", "smith-2020:a.b"), ("misc", "par"), ("book", "last")]
    f = dict(B.fields(got[0][2]))
    assert f["booktitle"] == "A book title" and f["year"] == "2021" and f["note"].startswith("50% of it") and f["author"] == "Smith, J. and {The {Deep} Group}"
    assert dict(B.fields(got[1][2])) == {"title": "In (round) ones", "doi": "10.1/x"}
    assert list(B.scan("")) == []


def test_last_of_two_values_stays():
    assert B.fields("a = {1}, A = {2}") == [("a", "2")]


def test_read_write_and_source(spark, tmp_path):
    (tmp_path / "in.bib").write_text(BIB, encoding="utf-8")
    rows = B.read_bibtex(spark, f"{tmp_path}/in.bib")
    assert [r.key for r in rows.orderBy("pos").collect()] == ["smith-2020:a.b", "par", "last"]
    spark.dataSource.register(B.BibtexSource)
    assert spark.read.format("bibtex").load(f"{tmp_path}/in.bib").count() == 3
    B.write_bibtex(rows.where("pos < 2"), f"{tmp_path}/out")
    again = B.read_bibtex(spark, f"{tmp_path}/out/*.txt")
    assert [(r.type, r.key, r.fields) for r in again.orderBy("pos").collect()] == [(r.type, r.key, r.fields) for r in rows.where("pos < 2").orderBy("pos").collect()]


def test_writing_needs_a_key(spark, tmp_path):
    bad = spark.createDataFrame([("f", 0, "article", None, "x = {1}")], "file string, pos int, type string, key string, content string")
    with pytest.raises(Exception, match="needs a type and a key"):
        B.write_bibtex(bad, f"{tmp_path}/out")


def test_regular_formats(spark):
    bs = "\\"
    bbl = f"{bs}bibitem[A(1)]{{k1}} {bs}bibitem{{ k2 }} {bs}entry{{e}}{{article}}{{}} {bs}entry{{no}} {bs}setentrytag{{t_1}} {bs}bibitem{{k1}}"
    tex = f"{bs}addbibresource[x]{{c.bib}} {bs}BIBLIOGRAPHY{{a , b,a}}"
    row = spark.createDataFrame([(bbl, tex, "# h\n 10.1/x \n\n #kept\r\ny", "@a{1,\n x}\n@b{2,\n y}\n")], "bbl string, tex string, ids string, bib string").select(B.bbl_keys(F.col("bbl")).alias("a"), B.bibliography_files(F.col("tex")).alias("b"), B.list_items(F.col("ids")).alias("c"), B.split_entries(F.col("bib")).alias("d")).collect()[0]
    assert (row.a, row.b, row.c, row.d) == (["k1", "k2", "e", "t_1", "k1"], ["a", "b", "c.bib"], ["10.1/x", "#kept", "y"], ["@a{1,\n x}", "@b{2,\n y}"])


def test_build(spark):
    cols = {"author": F.lit("A"), "year": F.lit("2020"), "eprint": F.lit("1.2"), "archiveprefix": F.lit("arXiv"), "title": F.lit("")}
    text = spark.range(1).select(B.build(F.lit("misc"), F.lit("k"), cols).alias("t")).collect()[0].t
    assert text == "@misc{k,\n  author     = {A},\n  year       = {2020},\n  eprint    = {1.2},\n  archiveprefix = {arXiv}\n}"


def test_payloads(spark):
    one = lambda payload, f: spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "p string").select(f(F.col("p")).alias("w")).collect()[0].w
    w = one({"doi": "10.1/a", "title": ["T"], "author": [{"family": "Doe", "given": "J"}, {"given": "X"}], "container-title": ["J"], "issued": {"date-parts": [[2001, 2]]}, "page": "1-2"}, P.crossref)
    assert (w.doi, w.title, w.authors, w.year, w.journal, w.pages) == ("10.1/a", "T", "Doe, J", "2001", "J", "1-2")
    w = one({"doi": "https://doi.org/10.1/a", "title": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, P.openalex)
    assert (w.doi, w.year, w.abstract, w.journal) == ("10.1/a", "2020", "a b a", "")
    assert one({"title": "T"}, P.scholar) is None
    assert one({"title": "T", "venue": "V", "externalIds": {"DOI": "10.1/a"}}, P.scholar).journal == "V"
    art = lambda people: {"MedlineCitation": {"Article": {"ArticleTitle": {"value": "T"}, "AuthorList": {"Author": people}, "Journal": {"Title": "J", "JournalIssue": {"Volume": "3"}}}}}
    assert one(art({"LastName": "Doe", "Initials": "J"}), P.pubmed).authors == "Doe, J"
    assert one(art([{"LastName": "Doe", "ForeName": "Jo"}, {"LastName": "Roe"}]), P.pubmed).authors == "Doe, Jo and Roe"
    assert one(art(None), P.pubmed).authors == "Unknown"


def test_readers_and_rewriting(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("a\n\n b \na\n")
    (tmp_path / "ids.txt").write_text("# head\n10.1/x\n\n 2106.12345 \n")
    (tmp_path / "d.tex").write_text("One line.\nTwo.")
    assert sorted(r.key for r in B.read_cited_keys(spark, str(tmp_path / "keys.txt")).collect()) == ["a", "b"]
    assert sorted(r.id for r in B.read_identifiers(spark, str(tmp_path / "ids.txt")).collect()) == ["10.1/x", "2106.12345"]
    assert [r.text for r in B.read_documents(spark, str(tmp_path / "d.tex")).collect()] == ["One line.\nTwo."]
    where = f"file://{tmp_path}/lib"
    rows = spark.createDataFrame([("f", i, "misc", f"k{i}", f"title = {{T{i}}}") for i in range(5)], "file string, pos int, type string, key string, content string")
    B.write_bibtex(rows, where)
    B.rewrite_bibtex(B.parse(spark.read.text(where, wholetext=True).selectExpr("'f' AS file", "value AS content")).where("key <> 'k2'"), where)
    assert sorted(r.key for r in B.parse(spark.read.text(where, wholetext=True).selectExpr("'f' AS file", "value AS content")).collect()) == ["k0", "k1", "k3", "k4"]
