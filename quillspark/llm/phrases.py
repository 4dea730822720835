"""Phrase collocation mining: Apriori passes over the corpus, one a length, then scores of cuts.

The pass for k words broadcasts the frequent phrases of k - 1 words and emits a phrase only where both
its overlapping parts are among them. What is broadcast is a filter of 2**FILTER_BITS bits whatever the
number of phrases, so its size is bounded; a part that it lets through by chance costs a counted
row, never a result, since counts are taken of the phrases themselves. Batches are counted before
they are shuffled, so a phrase that a third of all texts hold costs an entry a batch.

Results for odd rows: null and empty texts have no words; a null lang counts as `und`, and so meets
rows whose lang says that; a text of any length is one row of one batch; repeated rows count as often
as they stand there; ties go by phrase; an empty table gives no rows; doc_id and other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, release
from .hashing import LOWER, STEP, U, mix, word_hashes

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
FILTER_BITS = 26
#: Bits of a filter that one task lays together.
CHUNK_BITS = 16
#: Bytes of texts that are counted at once; a longer text is counted alone.
BATCH_BYTES = 4 << 20
#: Parts of a language's phrases that are ranked apart before their best meet.
RANK_PARTS = 64

SPACE, BREAK = 32, 10
CLASS = LOWER.copy()
CLASS[9] = SPACE
CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK
COUNTS = "lang string, phrase string, n long"


class Words:
    """The words of some texts, numbered by their distinct forms. of: each word's number; piece: of
    each word, the same as long as phrases may go on; owner: each word's text."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = CLASS[np.frombuffer(b"\n".join(texts), np.uint8)]
        word = np.zeros(len(data) + 2, np.int8)
        inside = (data != SPACE) & (data != BREAK)
        word[1:-1] = inside
        step = np.diff(word)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.cumsum(data == BREAK)[starts] if len(starts) else starts
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        kept = data[inside]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
        self.of, self.forms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.names = sorted(set(langs))
        code = {x: k for k, x in enumerate(self.names)}
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([code[x] for x in langs], np.int64)[np.searchsorted(limits, starts, "right")]

    def starts(self, k: int) -> np.ndarray:
        """Places at which k words of one piece begin."""
        n = len(self.of) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.empty(0, np.int64)

    def hashes(self, k: int) -> np.ndarray:
        """Of the k words from each place on, with their language."""
        at = np.frombuffer(self.forms.buffers()[1], np.int64)[: len(self.forms) + 1]
        text = self.forms.buffers()[2]
        of_forms = word_hashes(np.frombuffer(text, np.uint8) if text else np.empty(0, np.uint8), at[:-1], at[1:])
        words = of_forms[self.of]
        seeds = np.array([lang_seed(x) for x in self.names], U)
        out = mix(words ^ seeds[self.lang])
        for j in range(1, k):
            out = mix(out[: len(words) - j] * STEP + words[j:])
        return out

    def counts(self, at: np.ndarray, k: int) -> pa.Table:
        """The distinct phrases of k words that begin at the places `at`, with their numbers."""
        columns, room = [], 1
        for values, size in [(self.lang[at], len(self.names)), *((self.of[at + j], len(self.forms)) for j in range(k))]:
            if columns and room * size < 2**62:
                columns[-1], room = columns[-1] * size + values, room * size
            else:
                columns, room = [*columns, values], size
        order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
        new = np.zeros(len(at), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        one = at[order[first]]
        parts = [self.forms.take(pa.array(self.of[one + j])) for j in range(k)]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
        langs = pa.array(self.names, pa.string()).take(pa.array(self.lang[one]))
        return pa.table({"lang": langs, "phrase": phrases.cast(pa.large_string()).cast(pa.string()), "n": pa.array(n, pa.int64())})


def lang_seed(lang: str) -> int:
    data = np.frombuffer(b"\0" + lang.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def batches_of(batches):
    """(texts, langs) of some MB each."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if texts and size + len(text or b"") > BATCH_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
            texts.append(text or b"")
            langs.append("und" if lang is None else lang)
            size += len(text or b"")
    if texts:
        yield texts, langs


def count_words(batches):
    """Each batch's words, and under the null phrase the number of all of a language's words."""
    release()
    for texts, langs in batches_of(batches):
        words = Words(texts, langs)
        at = words.starts(1)
        yield from words.counts(at, 1).to_batches()
        sums = np.bincount(words.lang, minlength=len(words.names))
        yield pa.record_batch({"lang": pa.array(words.names, pa.string()), "phrase": pa.nulls(len(sums), pa.string()), "n": pa.array(sums, pa.int64())})


def count_phrases(k: int, filter_):
    def run(batches):
        release()
        bits = np.frombuffer(filter_.value, np.uint8)
        for texts, langs in batches_of(batches):
            words = Words(texts, langs)
            at = words.starts(k)
            place = words.hashes(k - 1) >> U(64 - FILTER_BITS) if len(at) else np.empty(0, U)
            known = (bits[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 > 0
            at = at[known[at] & known[at + 1]] if len(at) else at
            if len(at):
                yield from words.counts(at, k).to_batches()

    return run


def filter_of(frequent: DataFrame, k: int) -> bytes:
    """The bits of frequent(lang, phrase) of k words each: 2**FILTER_BITS of them."""

    def places(batches):
        for texts, langs in batches_of(batches):
            words = Words(texts, langs)
            place = np.unique(words.hashes(k)[words.starts(k)] >> U(64 - FILTER_BITS))
            of = (place >> U(CHUNK_BITS)).astype(np.int64)
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            parts = np.split((place & U((1 << CHUNK_BITS) - 1)).astype("<u4"), edge[1:]) if len(edge) else []
            yield pa.record_batch({"chunk": pa.array(of[edge], pa.int64()), "places": pa.array([p.tobytes() for p in parts], pa.binary())})

    def laid(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << CHUNK_BITS, np.uint8)
        for p in table["places"].to_pylist():
            flags[np.frombuffer(p, "<u4")] = 1
        return pa.table({"chunk": table["chunk"][:1], "places": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    schema = "chunk long, places binary"
    rows = frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(places, schema).groupBy("chunk").applyInArrow(laid, schema)
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = 1 << (CHUNK_BITS - 3)
    for r in rows.toLocalIterator():
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.places, np.uint8)
    return out.tobytes()


def levels(docs: DataFrame, scratch: Scratch, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n): words of each language; (lang, phrase, k, f): the phrases found `least` times or more."""
    spark, texts = docs.sparkSession, docs.select("lang", "text")
    summed = lambda made: made.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = scratch.put(summed(texts.mapInArrow(count_words, COUNTS)).where(F.col("phrase").isNull() | (F.col("f") >= least)), "level1")
    total = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    level = words.where("phrase is not null")
    found = level.withColumn("k", F.lit(1))
    for k in range(2, longest + 1):
        filter_ = spark.sparkContext.broadcast(filter_of(level, k - 1))
        level = scratch.put(summed(texts.mapInArrow(count_phrases(k, filter_), COUNTS)).where(F.col("f") >= least), f"level{k}")
        filter_.unpersist()
        if level.isEmpty():
            break
        found = found.union(level.withColumn("k", F.lit(k)))
    return total, found


def scored(total: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more that no longer one holds
    as often: each one's lowest cut, found by joining the level tables."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    piece = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    many = found.where("k > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("left"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(total, "lang")
    # 1000 a n is below 10**38 for corpora of up to 10**17 words, and the quotient below 2**63.
    score = F.expr("cast(cast(1000 as decimal(19,0)) * a as decimal(38,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("a", exact("a")).withColumn("score", score).withColumn("a", F.col("a").cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.score", "b.l", "b.r")
    long = many.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    held = long.select("lang", piece(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return best.join(held, ["lang", "phrase"], "left").where("most is null or most < a").drop("most")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of docs(lang, text)."""
    scratch = Scratch(docs.sparkSession, "phrases")
    rows = scored(*levels(docs, scratch, least, longest))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # A language's best come from the best of its parts, so that no task ranks all of its phrases.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", at("lang", "part")).where(F.col("rank") <= top)
    return rows.withColumn("rank", at("lang").cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w),
f AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, count(*)::HUGEINT AS f FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
m AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
c AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM m),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n, 1000 * c.a * t.n // (x.f * y.f) AS score FROM c JOIN t USING (lang)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT lang, w, a, k, unnest(generate_series(2, k - 1)) AS size FROM m WHERE k > 2),
h AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS i FROM z) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE most IS NULL OR most < a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
