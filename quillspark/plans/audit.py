"""The document audit as one lazy plan: sentences, citations, need, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

LEAST = 20


def sentence_rows(docs: DataFrame) -> DataFrame:
    """A row a sentence of LEAST characters or more: the columns of docs, idx, sentence."""
    # Not `posexplode`, which filters by its array first, and so cuts each text twice.
    rows = docs.select("*", F.posexplode_outer(T.sentences(F.coalesce("text", F.lit("")))).alias("idx", "sentence")).drop("text")
    return rows.where(F.length("sentence") >= LEAST)


def analyses(docs: DataFrame, audit_cited: bool = False) -> DataFrame:
    """Each sentence with its citations, confidence, reason and, if it needs any, search terms.
    audit_cited: sentences with citations are judged as if they had none."""
    rows = sentence_rows(docs)
    cited = (F.size("existing_citations") > 0) & F.lit(not audit_cited)
    rows = rows.withColumn("existing_citations", T.citations(F.col("sentence"))).withColumn("need", S.citation_need(F.col("sentence")))
    rows = rows.withColumn("has_citation", F.size("existing_citations") > 0).withColumn("confidence", F.col("need.score"))
    rows = rows.withColumn("needs_citation", (F.col("confidence") >= 0.3) & ~cited).withColumn("reason", S.reason(F.col("confidence"), F.col("need.tags"), cited))
    return rows.withColumn("search_terms", F.when(F.col("needs_citation"), T.search_terms(F.col("sentence"))).otherwise(F.array().cast("array<string>"))).drop("need")


def counters() -> list:
    """Aggregates of total, cited, needing and fine sentences."""
    n = lambda c: F.count_if(c)
    fine = ~F.col("has_citation") & ~F.col("needs_citation")
    return [F.count("*").alias("total"), n(F.col("has_citation")).alias("with_citations"), n(F.col("needs_citation")).alias("needing"), n(fine).alias("ok")]


def counts(rows: DataFrame, by: str) -> DataFrame:
    """Total, cited, needing and fine sentences."""
    return rows.groupBy(by).agg(*counters())


def report(rows: DataFrame, by: str) -> DataFrame:
    """A line of JSON a document's sentence, as the machine-readable report has them."""
    return rows.select(by, "idx", F.to_json(F.struct("sentence", "needs_citation", "confidence", "reason", "has_citation", "search_terms")).alias("line"))
