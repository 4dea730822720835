"""The commands as plans."""

import json

from pyspark.sql import functions as F

from quillspark.plans import workflows as W

LOCAL = "pos int, cite_key string, doi string, title string, authors string, year string, abstract string, journal string, source string, volume string, pages string, eprint string"
FOUND = "sent_id int, tier int, source string, pos int, cite_key string, doi string, title string, authors string, year string, abstract string, journal string"


def found(spark, rows):
    return spark.createDataFrame(rows, FOUND)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


QUBIT = "Here we demonstrate a qubit coupled to phonons in a crystal at low temperature."
BOTANY = "Here we report growth of algae under red light in shallow water over many weeks."


def two_sentences(spark):
    s = spark.createDataFrame([(1, "Red light speeds algae growth"), (2, "A crystal with low temperature noise")], "sent_id int, sentence string")
    far = found(spark, [(1, 0, "CrossRef", 0, "a", "10.1/A", "Algae growth", "B", "2001", f"Algae matter. {BOTANY}", "J"), (2, 0, "CrossRef", 0, "q", "10.1/Q", "Crystal noise", "C", "2002", f"Low temperature is nice. {QUBIT}", "J")])
    return s, spark.createDataFrame([], LOCAL), far


def test_each_suggestion_has_its_own_evidence(spark):
    """Two works at the same place of two sentences' lists."""
    got = by(W.suggest(*two_sentences(spark)), "sent_id")
    assert (got[1,].best_evidence, got[2,].best_evidence) == (BOTANY, QUBIT)
    assert got[2,].reference_note == f"Crystal noise. {QUBIT}"


def test_inline_citations(spark):
    """By DOI in any case, by an entry's own fields, or none."""
    s, _, far = two_sentences(spark)
    works = spark.createDataFrame([("10.1/q", "Nano Lett.", "7", "12", "2003", "")], "doi string, journal string, volume string, pages string, year string, eprint string")
    s = s.union(spark.createDataFrame([(3, "Zebra stripes confuse flies")], s.schema))
    local = spark.createDataFrame([(0, "z", "", "Zebra stripes", "D", "1999", "", "Nature", "local-bib", "3", "44", "")], LOCAL)
    got = by(W.suggest(s, local, far, works=works), "sent_id")
    assert (got[1,].inline_citation, got[2,].inline_citation, got[3,].inline_citation) == ("", "Nano Lett. 7, 12 (2003)", "Nature 3, 44 (1999)")


def test_only_results_that_score_and_are_no_preprints(spark):
    s = spark.createDataFrame([(1, "Superconducting qubit sensors detect mechanical phonons via piezoelectric coupling to acoustic modes.")], "sent_id int, sentence string")
    far = found(spark, [(1, 0, "CrossRef", k, f"k{k}", d, t, "A", "2020", a, j) for k, (d, t, a, j) in enumerate([
        ("", "Cavity optomechanics", "Optical cavities couple to mechanical motion.", "Reviews of Modern Physics"),
        ("", "Resolving the energy of a single mechanical phonon with a superconducting qubit", "A superconducting qubit detects acoustic phonons through piezoelectric coupling.", "Nature"),
        ("10.48550/arXiv.1", "A superconducting qubit and a phonon", "Piezoelectric coupling of acoustic modes.", "Nature")])])
    assert [r.cite_key for r in W.suggest(s, spark.createDataFrame([], LOCAL), far).collect()] == ["k1"]
    assert {r.cite_key for r in W.suggest(s, spark.createDataFrame([], LOCAL), far, allow_arxiv=True).collect()} == {"k1", "k2"}


def test_at_most_so_many_rows_of_a_registry_are_asked_for(spark):
    """Six for three suggestions: a better one at the seventh place is not seen."""
    s = spark.createDataFrame([(1, "Zebra stripes confuse flies")], "sent_id int, sentence string")
    far = found(spark, [(1, 0, "CrossRef", k, f"k{k}", "", "Zebra" if k < 6 else "Zebra stripes confuse flies", "A", "2020", "", "") for k in range(8)])
    assert {r.cite_key for r in W.suggest(s, spark.createDataFrame([], LOCAL), far).collect()} == {"k0", "k1", "k2"}
    assert W.suggest(s, spark.createDataFrame([], LOCAL), far, most=4).where("cite_key = 'k6'").count() == 1


def test_audit_with_suggestions_in_its_reports(spark):
    text = "Previous studies have shown that zebra stripes significantly confuse flies by 40% compared to plain hides. We think so."
    docs = spark.createDataFrame([(5, text), (6, "Nothing to see here, my friends."), (7, None)], "doc long, text string")
    local = spark.createDataFrame([(0, "z", "10.1/z", "Zebra stripes", "Doe", "1999", "Stripes. Here we show that flies avoid zebra stripes in open fields.", "Nature", "local-bib", "", "", "")], LOCAL)
    works = spark.createDataFrame([("10.1/Z", "Nature", "3", "44", "1999", "")], "doi string, journal string, volume string, pages string, year string, eprint string")
    rows = W.audited(docs, "doc", local, works=works)
    first = rows.where("doc = 5 and idx = 0").collect()[0]
    assert first.needs_citation and [s.inline_citation for s in first.suggestions] == ["Nature 3, 44 (1999)"]
    assert first.suggestions[0].best_evidence == "Here we show that flies avoid zebra stripes in open fields."
    assert rows.where("doc = 6 and size(suggestions) > 0").count() == 0
    report = {r.doc: r.report for r in W.text_report(rows, "doc").collect()}
    assert "    - Zebra stripes...\n      Doe (1999)\n      DOI: 10.1/z\n      Inline: Nature 3, 44 (1999)\n      Note: " in report[5]
    told = json.loads({r.doc: r.report for r in W.json_report(rows, "doc").collect()}[5])
    assert told["suggested_citations"][0]["inline_citation"] == "Nature 3, 44 (1999)"


def test_payloads_of_one_id_are_always_the_same(spark):
    rows = spark.createDataFrame([("crossref", "10.1/A", "Z", "2001"), ("crossref", "10.1/a", "A", "2000")], "source string, id string, author string, year string")
    cited, lib = spark.createDataFrame([("k", 1)], "key string, ord int"), spark.createDataFrame([], "pos long, key string, doi string")
    original = spark.createDataFrame([(0, "k", "10.1/A")], "pos int, key string, doi string")
    got = W.sync_cited(cited, lib, original, rows).collect()
    assert [(r.key, r.author, r.added) for r in got] == [("k", "A", True)]


def test_extract_statuses(spark):
    ids = spark.createDataFrame([(0, "10.1234/have"), (1, "10.1234/New"), (2, "https://doi.org/10.1234/nEW"), (3, "10.1234/none")], "pos int, id string")
    lib = spark.createDataFrame([(0, "old", "10.1234/HAVE", "", "")], "pos int, key string, doi string, url string, eprint string")
    payloads = spark.createDataFrame([("crossref", "10.1234/new", "Doe, J", "Deep title", "2020")], "source string, id string, author string, title string, year string")
    got = W.extract(ids, lib, payloads)
    assert {r.pos: (r.status, r.key) for r in got.collect()} == {0: ("existing", "old"), 1: ("added", "Doe2020Deeptit"), 2: ("added", "Doe2020Deeptit"), 3: ("failed", None)}
    assert W.batch_counts(got).collect()[0] == (3, 1)
    assert W.with_extracted(got, lib, payloads).select(F.count("*")).collect()[0][0] == 2


def test_extraction_sends_no_side_to_the_driver(spark):
    ids = spark.createDataFrame([(0, "10.1234/a"), (1, "10.1234/b")], "pos long, id string")
    lib = spark.createDataFrame([(0, "k", "10.1234/a", "", "")], "pos long, key string, doi string, url string, eprint string")
    pay = spark.createDataFrame([("crossref", "10.1234/B", "Doe, J", "T", "2001")], "source string, id string, author string, title string, year string")
    got = W.extract(ids, lib, pay)
    assert {(r.pos, r.status, r.key) for r in got.collect()} == {(0, "existing", "k"), (1, "added", "Doe2001T")}
    for plan in (got, W.with_extracted(got, lib, pay).where("pos >= 0")):
        assert plan._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
