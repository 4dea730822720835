"""Sentences against candidate references: scores, ranks, and the best evidence of a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

#: A token that more candidates have is looked up once for each set of such tokens, not once a sentence.
HEAVY = 256


def prepared_sentences(sentences: DataFrame) -> DataFrame:
    """Terms, claims and anchors of sentences(sent_id, sentence), once each."""
    s = F.col("sentence")
    return sentences.select("sent_id", T.search_terms(s).alias("s_terms"), T.claims(s).alias("s_claims"), T.anchor_terms(s).alias("s_anchors"), S.topics(F.lower(s)).alias("s_topics"))


#: All that a sentence's scores depend on.
ASKED = "s_terms array<string>, s_claims array<struct<value:string,unit:string>>, s_anchors array<string>, s_topics array<string>"


def digest(value) -> Column:
    """Never null, so that joins by it put no filter, and with it no second reading, below what it is made of."""
    return F.coalesce(F.sha2(F.coalesce(value, F.lit("")), 256), F.lit(""))


def asked(s: DataFrame) -> DataFrame:
    """(sent_id, asks) of prepared sentences, with all that scores depend on as one string: whatever is
    built on it needs both columns, so that plans share one exchange and each sentence is read once."""
    asks = F.coalesce(F.to_json(F.struct("s_terms", "s_claims", "s_anchors", "s_topics")), F.lit(""))
    return s.where("sent_id is not null").select("sent_id", asks.alias("asks")).repartition("sent_id")


def prepared_texts(rows: DataFrame, *keep: str) -> DataFrame:
    """Terms, numbers and topics of rows(title, abstract, journal)."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat_ws(" ", part("title"), part("abstract"), part("journal"))
    hay = F.lower(whole)
    return rows.select(*keep, F.lower(part("title")).alias("title"), hay.alias("hay"), T.search_terms(whole).alias("c_terms"), S.numbers(hay).alias("c_numbers"), S.topics(hay).alias("c_topics"))


def prepared_candidates(candidates: DataFrame, *keep: str) -> DataFrame:
    """The same of candidates(pos, cite_key, title, abstract, journal)."""
    return prepared_texts(candidates, *keep, "pos", "cite_key")


def rank(sentences: DataFrame, candidates: DataFrame, most: int | None = 3, heavy: int = HEAVY) -> DataFrame:
    """sent_id, cite_key, score, anchor_matches and rank of the best candidates of each sentence
    (all of them if most is None). Ties go by pos."""
    return rank_asked(asked(prepared_sentences(sentences)), candidates, most, heavy)


def rank_asked(asks: DataFrame, candidates: DataFrame, most: int | None = 3, heavy: int = HEAVY) -> DataFrame:
    """`rank` for `asked` sentences."""
    c = named(prepared_candidates(candidates))
    got = best_of(scored(asks, c, most, heavy), "sent_id", most)
    return got.join(c.select("pos", "c_id", "cite_key"), ["pos", "c_id"]).select("sent_id", "pos", "cite_key", "score", F.col("matched").alias("anchor_matches"), "rank")


def best_of(rows: DataFrame, by: str, most: int | None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "pos")))
    return out if most is None else out.where(F.col("rank") <= most)


def rank_given(sentences: DataFrame, candidates: DataFrame, most: int | None = 3) -> DataFrame:
    """`rank` where each row of candidates(sent_id, pos, …) was fetched for one sentence."""
    return rank_given_asked(asked(prepared_sentences(sentences)), candidates, most).select("sent_id", "row.pos", "row.cite_key", "score", "anchor_matches", "rank")


def rank_given_asked(asks: DataFrame, candidates: DataFrame, most: int | None = 3) -> DataFrame:
    """sent_id, score, anchor_matches and rank, and each candidate as row. Equal texts are read once,
    however many sentences they were fetched for."""
    c = candidates.withColumn("_text", digest(F.to_json(F.struct("title", "abstract", "journal"))))
    texts = prepared_texts(c.select("_text", "title", "abstract", "journal").distinct(), "_text")
    given = c.select("sent_id", "pos", "_text", F.struct(*candidates.columns).alias("row"))
    s = asks.select("sent_id", F.from_json("asks", ASKED).alias("s")).select("sent_id", "s.*")
    return ranked(given.join(s, "sent_id").join(texts, "_text"), most)


def ranked(met: DataFrame, most: int | None) -> DataFrame:
    """Scores and ranks of pairs of a prepared sentence and a prepared candidate."""
    anchor = S.anchored(F.col("s_anchors"), F.col("title"), F.col("hay"))
    met = met.withColumn("anchor", anchor)
    total = S.overlap(F.col("s_terms"), F.col("c_terms")) + S.quantitative(*map(F.col, ("s_topics", "s_claims", "hay", "c_numbers", "c_topics"))) + F.col("anchor.score")
    total = F.when((F.size("s_anchors") > 0) & (F.col("anchor.matched") == 0), 0.0).otherwise(total)
    # Pairs without a score come last, so they may be ranked; a filter before would score all pairs twice.
    rows = met.select("sent_id", "pos", "row", F.round(total, 4).alias("score"), F.col("anchor.matched").cast("long").alias("anchor_matches"))
    return best_of(rows, "sent_id", most).where("score > 0")


# A score is a sum over a sentence's tokens: terms, units, numbers and topics add a weight for each that a
# candidate has, anchors more if its title has them, and a sentence with anchors needs one of them. So
# scores are sums over exact postings (token, pos), and no text is joined to a pair. Weights are hundredths
# and shares of at most 8 terms, so no sum is near the middle between two values of four digits, and
# the order of the terms doesn't change what it is rounded to. Sentences that ask the same are scored once.
# A token that many candidates have would make as many pairs a sentence; but sentences with the same such
# tokens get the same sums from them, so the best candidates are found once for each distinct set.

def met(s: DataFrame, c: DataFrame, most: int | None, heavy: int = HEAVY) -> DataFrame:
    """(sent_id, pos): every pair with a score, or if `most` is given those that can be among a
    sentence's best; s and c are prepared sentences and candidates."""
    return scored(asked(s), named(c), most, heavy).select("sent_id", "pos").distinct()


def named(c: DataFrame) -> DataFrame:
    """Candidates with a number that tells rows of one pos apart."""
    return c.withColumn("c_id", F.xxhash64("cite_key", "title", "hay"))


def scored(asks: DataFrame, c: DataFrame, most: int | None, heavy: int = HEAVY) -> DataFrame:
    """sent_id, pos, c_id, score and matched (anchors) of the pairs of `met`; asks and c are `asked`
    sentences and `named` candidates."""
    tokens = sentence_tokens(asks.select("asks").distinct().select(digest(F.col("asks")).alias("id"), F.from_json("asks", ASKED).alias("s")).select("id", "s.*"))
    postings = candidate_tokens(c).unionByName(number_postings(tokens, c)).unionByName(unit_postings(tokens, c))
    fits = (F.round("score", 4) > 0) & (~F.col("anchored") | (F.col("matched") > 0))

    def sums(rows: DataFrame, by: str) -> DataFrame:
        hit = rows.join(postings, "token")
        return hit.groupBy(by, "anchored", "pos", "c_id").agg(F.sum(F.col("weight") * F.col("boost")).alias("score"), F.count_if(F.col("token").startswith("a:")).alias("matched"))

    if most is None:
        pairs = sums(tokens, "id")
    else:
        often = postings.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("token")
        light = sums(tokens.join(often, "token", "left_anti"), "id")
        # Sentences by their set of frequent tokens, each set's sums, and its best candidates.
        sets = tokens.join(often, "token").groupBy("id", "anchored").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("set"))
        sets = sets.withColumn("set_id", digest(F.to_json(F.struct("set", "anchored"))))
        each = sets.select("set_id", "anchored", "set").dropDuplicates(["set_id"]).select("set_id", "anchored", F.explode("set").alias("t")).select("set_id", "anchored", "t.*")
        common = sums(each, "set_id")
        best = best_of(common.where(fits).withColumn("score", F.round("score", 4)), "set_id", most).select("set_id", "pos", "c_id")
        more = common.select("set_id", "pos", "c_id", F.col("score").alias("also"), F.col("matched").alias("also_matched"))
        # What a pair has by rare tokens and by frequent ones, and the best by frequent ones alone.
        light = light.join(sets.select("id", "set_id"), "id", "left").join(more, ["set_id", "pos", "c_id"], "left")
        light = light.select("id", "anchored", "pos", "c_id", (F.col("score") + F.coalesce("also", F.lit(0.0))).alias("score"), (F.col("matched") + F.coalesce("also_matched", F.lit(0))).alias("matched"))
        alone = sets.select("id", "anchored", "set_id").join(best.join(more, ["set_id", "pos", "c_id"]), "set_id").select("id", "anchored", "pos", "c_id", F.col("also").alias("score"), F.col("also_matched").alias("matched"))
        pairs = light.unionByName(alone).groupBy("id", "anchored", "pos", "c_id").agg(F.max("score").alias("score"), F.max("matched").alias("matched"))
    pairs = pairs.where(fits).select("id", "pos", "c_id", F.round("score", 4).alias("score"), "matched")
    if most is not None:
        pairs = best_of(pairs, "id", most).drop("rank")
    return asks.select("sent_id", digest(F.col("asks")).alias("id")).join(pairs, "id").drop("id")


def sentence_tokens(s: DataFrame) -> DataFrame:
    """id, anchored, token, weight and kind of rows(id, …) of what sentences ask; what is claimed twice
    stands twice."""
    token = lambda kind, x, weight: F.struct(F.concat(F.lit(kind), x).alias("token"), weight.cast("double").alias("weight"))
    terms = F.transform(F.array_distinct("s_terms"), lambda x: token("t:", x, F.lit(1.0) / F.size(F.array_distinct("s_terms"))))
    numbers = F.transform("s_claims", lambda x: token("n:", x["value"].cast("double").cast("string"), F.lit(1.0)))
    units = F.transform(F.filter("s_claims", lambda x: x["unit"] != ""), lambda x: token("u:", F.lower(x["unit"]), F.lit(0.35)))
    topics = F.transform(F.when(F.size("s_claims") > 0, F.col("s_topics")).otherwise(F.array().cast("array<string>")), lambda x: token("s:", x, F.lit(0.25)))
    anchors = F.transform("s_anchors", lambda x: token("a:", x, F.lit(1.0)))
    # Not `explode`, which filters by its array first, and so makes it twice.
    rows = s.select("id", F.coalesce(F.size("s_anchors") > 0, F.lit(False)).alias("anchored"), F.explode_outer(F.concat(terms, numbers, units, topics, anchors)).alias("t"))
    return rows.select("id", "anchored", "t.*").where("token is not null").withColumn("kind", F.substring("token", 1, 2))


def candidate_tokens(c: DataFrame) -> DataFrame:
    """token, pos, c_id and boost of terms, topics and anchors."""
    token = lambda kind, x, boost: F.struct(F.concat(F.lit(kind), x).alias("token"), boost.alias("boost"))
    one = F.lit(1.0)
    terms = F.transform(F.array_distinct("c_terms"), lambda x: token("t:", x, one))
    topics = F.transform("c_topics", lambda x: token("s:", x, one))
    had = T.present(F.array(*[F.when(F.contains("hay", F.lit(x)), F.lit(x)) for x, _ in S.rules.ANCHORS]))
    anchors = F.transform(had, lambda x: token("a:", x, F.when(F.contains("title", x), 1.4).otherwise(0.8)))
    return c.select("pos", "c_id", F.explode_outer(F.concat(terms, topics, anchors)).alias("t")).select("t.token", "pos", "c_id", "t.boost").where("token is not null")


def grid(low, high):
    """Cells of a logarithmic grid from one number to another."""
    cell = lambda v: F.floor(F.log(F.greatest(v, F.lit(0.0)) + 2.0) / 0.1)
    return F.sequence(cell(low), cell(high))


def number_postings(tokens: DataFrame, c: DataFrame) -> DataFrame:
    """Postings of the sentences' distinct numbers: the candidates with a number near enough."""
    value = F.substring("token", 3, 400).try_cast("double")
    near = F.greatest(F.lit(0.15), F.col("value") * F.lit(0.08))
    asked = tokens.where("kind = 'n:'").select("token").distinct().withColumn("value", value).withColumn("near", near)
    asked = asked.withColumn("cell", F.explode(grid(F.col("value") - F.col("near"), F.col("value") + F.col("near"))))
    have = c.select("pos", "c_id", F.explode_outer("c_numbers").alias("x")).where("x is not null")
    have = have.withColumn("cell", F.explode(grid(F.col("x"), F.col("x"))))
    hit = asked.join(have, "cell").where(F.abs(F.col("x") - F.col("value")) <= F.col("near"))
    return hit.select("token", "pos", "c_id", F.lit(1.0).alias("boost")).distinct()


def unit_postings(tokens: DataFrame, c: DataFrame) -> DataFrame:
    """Postings of the sentences' distinct units: the candidates that contain them. A unit is letters or
    a percent sign, so it lies in a run of such; it is looked up in the runs that candidates have by its
    first three characters at most, and compared."""
    runs = c.select("pos", "c_id", F.explode_outer(F.array_distinct(T.every(F.col("hay"), "[a-zμµ]+|%"))).alias("run")).where("run is not null")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.array(*[F.substring(F.col("run"), i, F.lit(k)) for k in (1, 2, 3)]))))
    forms = runs.select("run").distinct().withColumn("gram", F.explode(grams))
    asked = tokens.where("kind = 'u:'").select("token").distinct().withColumn("unit", F.substring("token", 3, 1 << 20)).withColumn("gram", F.substring("unit", 1, 3))
    held = asked.join(forms, "gram").where(F.contains("run", F.col("unit"))).select("token", "run")
    return held.join(runs, "run").select("token", "pos", "c_id", F.lit(1.0).alias("boost")).distinct()


def best_evidence(candidates: DataFrame) -> DataFrame:
    """pos, best_evidence and reference_note of candidates(pos, title, abstract)."""
    title = T.strip_latex(F.coalesce("title", F.lit("")))
    rows = candidates.select("pos", title.alias("title"), T.title_terms(F.coalesce("title", F.lit(""))).alias("terms"), F.posexplode_outer(T.abstract_sentences(F.col("abstract"))).alias("i", "sentence"))
    rows = rows.withColumn("score", S.evidence(F.col("sentence"), F.col("terms"), F.col("i")))
    best = rows.groupBy("pos").agg(F.max_by(F.struct("title", "sentence"), F.struct(F.coalesce("score", F.lit(0.0)), -F.coalesce("i", F.lit(0)))).alias("b"))
    sentence, t = F.col("b.sentence"), F.col("b.title")
    note = F.when((t != "") & ~F.contains(F.lower(sentence), F.lower(t)), F.concat(t, F.lit(". "), sentence)).otherwise(sentence)
    return best.select("pos", F.coalesce(sentence, t).alias("best_evidence"), F.when(sentence.isNull(), t).otherwise(note).alias("reference_note"))


def first_source(rows: DataFrame, by: str, tier: str) -> DataFrame:
    """Of each group the rows of its first tier that has any."""
    low = rows.groupBy(by).agg(F.min(tier).alias("_low"))
    return rows.join(low, by).where(F.col(tier) == F.col("_low")).drop("_low")
