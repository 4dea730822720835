"""Ranking: what is read, rows with equal ids, long texts."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import matching as M

SENTENCE, CANDIDATE = "sent_id int, sentence string", "pos int, cite_key string, title string, abstract string, journal string"


def exchanges(df, below):
    """How often an executed plan reads a source below its exchanges, by a word of what it makes there."""
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(below in line for line in done.splitlines())


def test_sentences_are_read_once_for_their_ranks(spark, tmp_path):
    """Whatever a ranking needs of a sentence stands below one exchange, that all steps share."""
    s = spark.createDataFrame([(k, f"alpha {k % 7} phonons in beta {k}") for k in range(30)], SENTENCE)
    c = spark.createDataFrame([(k, f"c{k}", f"alpha {k}", "beta phonon", "") for k in range(5)], CANDIDATE)
    s.write.parquet(f"{tmp_path}/s")
    assert exchanges(M.rank(spark.read.parquet(f"{tmp_path}/s"), c, 3), f"{tmp_path}/s") == 1


def test_rows_with_equal_ids_are_ranked_as_they_stand(spark):
    """Sentences of one id keep their own scores, and so do candidates of one pos."""
    s = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma delta"), (2, "alpha beta"), (None, "alpha")], SENTENCE)
    c = spark.createDataFrame([(0, "a", "alpha", "", ""), (0, "b", "alpha beta", "", "")], CANDIDATE)
    got = sorted((r.sent_id, r.cite_key, r.score) for r in M.rank(s, c, 9).collect())
    assert got == [(1, "a", 0.3333), (1, "a", 0.5), (1, "b", 0.3333), (1, "b", 1.0), (2, "a", 0.5), (2, "b", 1.0)]


def test_terms_of_long_texts(spark):
    """A start that doesn't settle the terms is no end: few words, or a domain term far behind."""
    fill = "the of and " * 40
    rows = [(0, fill + "late words here Tall Tree"), (1, "one two three four five six seven eight nine " + fill + "a phonon-laser"), (2, "one two three four five six seven eight nine " + fill), (3, "x" * 300 + " end of it")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, x string").select("i", T.search_terms(F.col("x")).alias("t")).collect()}
    words = "one two three four five six seven eight".split()
    assert got[0] == ["late", "words", "here", "tall", "tree", "tall tree"] and got[1] == ["phonon", *words[:7]] and got[2] == words and got[3] == ["x" * 300, "end"]
