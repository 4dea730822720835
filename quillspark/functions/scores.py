"""Citation need, evidence and match scores. Sums run term by term in DOUBLE, in a fixed order:
three needs less three commonplaces must stay just below 0.3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import anchor_terms, claims, every, folded, found_in, let, present, search_terms, word_count


def tags(text: Column, low: Column, table, prefix: str = "") -> Column:
    """low: the text, `folded`."""
    return present(F.array(*[F.when(found_in(low, text, p, True), F.lit(prefix + tag)) for p, tag in table]))


def citation_need(sentence: Column, need=rules.NEED, common=rules.COMMON) -> Column:
    """(score, tags): each rule is tried once."""

    def of(hit: Column) -> Column:
        score = F.size(hit["need"]) * F.lit(0.25)
        for k in range(1, len(common) + 1):
            score = F.when(F.size(hit["common"]) >= k, score - F.lit(0.15)).otherwise(score)
        score = F.when((score > 0) & (word_count(sentence) > 15), score + F.lit(0.1)).otherwise(score)
        score = score + F.lit(0.1) * F.least(F.size(every(sentence, r"(?=[A-Z])\b[A-Z][a-z]+(?:ing|tion|ment|ness|ity)\b")), F.lit(3))
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.concat(hit["need"], hit["common"]).alias("tags"))

    return let(let(folded(sentence), lambda low: F.struct(tags(sentence, low, need).alias("need"), tags(sentence, low, common, "reduced:").alias("common"))), of)


def reason(score: Column, tags_: Column, cited: Column) -> Column:
    first = F.array_join(F.slice(tags_, 1, 3), ", ")
    return F.when(cited, "Already has citation").when(score >= 0.3, F.concat(F.lit("Citation recommended: "), first)).otherwise("Common knowledge or opinion statement")


def overlap(source_terms: Column, candidate_terms: Column) -> Column:
    share = F.size(F.array_intersect(source_terms, candidate_terms)) / F.size(F.array_distinct(source_terms)).cast("double")
    return F.when((F.size(source_terms) > 0) & (F.size(candidate_terms) > 0), share).otherwise(0.0)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(every(text, r"\d+(?:\.\d+)?"), lambda x: x.cast("double")))


def topics(text: Column, shared=rules.SHARED_TERMS) -> Column:
    """Which of the shared terms a lower-cased text has."""
    return let(text, lambda t: present(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(x)) for x in shared])))


def quantitative(sentence_topics: Column, sentence_claims: Column, haystack: Column, hay_numbers: Column, hay_topics: Column) -> Column:
    """haystack: lower-cased title, abstract and journal, with its numbers and topics."""

    def of(c: Column) -> Column:
        value = c["value"].cast("double")
        near = F.exists(hay_numbers, lambda x: F.abs(x - value) <= F.greatest(F.lit(0.15), value * F.lit(0.08)))
        unit = (c["unit"] != "") & F.contains(haystack, F.lower(c["unit"]))
        return F.when(near, 1.0).otherwise(0.0) + F.when(unit, 0.35).otherwise(0.0)

    total = F.aggregate(sentence_claims, F.lit(0.0), lambda a, c: a + of(c))
    both = F.size(F.array_intersect(sentence_topics, hay_topics))
    return F.when(F.size(sentence_claims) > 0, total + both * F.lit(0.25)).otherwise(0.0)


def anchored(anchors: Column, title: Column, haystack: Column) -> Column:
    """(score, matched); title and haystack in lower case."""
    score = F.aggregate(anchors, F.lit(0.0), lambda a, x: a + F.when(F.contains(haystack, x), F.when(F.contains(title, x), 1.4).otherwise(0.8)).otherwise(0.0))
    return F.struct(score.alias("score"), F.size(F.filter(anchors, lambda x: F.contains(haystack, x))).alias("matched"))


def evidence(sentence: Column, title_terms: Column, index: Column) -> Column:
    """How well a sentence of an abstract says what the work does."""
    low = F.lower(sentence)
    score = F.lit(0.0)
    for p, w in (*rules.CONTRIBUTION, *rules.BACKGROUND):
        score = score + F.when(found_in(low, low, p), F.lit(w)).otherwise(0.0)
    back = F.lit(False)
    for p, _ in rules.BACKGROUND:
        back = back | found_in(low, low, p)
    score = score - F.when((index == 0) & back, 1.0).otherwise(0.0)
    words = F.array_distinct(every(low, r"(?=[A-Za-z])\b[A-Za-z][A-Za-z0-9/-]{1,}\b"))
    score = score + F.least(F.size(F.array_intersect(words, title_terms)) * F.lit(0.35), F.lit(2.0))
    n = word_count(sentence)
    return score + F.when(n.between(8, 35), 0.4).when(n < 5, -0.8).otherwise(0.0)


__all__ = ["anchor_terms", "anchored", "citation_need", "claims", "evidence", "overlap", "quantitative", "reason", "search_terms"]
