"""Toxicity by weak supervision.

1. Voters. Words of a general lexicon of insults, patterns of shouting, and words and word
   beginnings mined from labelled rows: those whose presence in toxic rows exceeds what chance
   explains (G squared), after several different words, so that copies of one toxic text don't
   make its rare words voters.
2. Label model. A two-class generative model over the votes, fitted by expectation maximisation
   that starts from the labels: each voter's rates of firing in toxic and clean texts are its
   accuracies. Correlations between voters, beyond what the class explains, are estimated from the
   residuals; voters tied by them form groups, and of a group only the strongest vote counts.
3. A linear classifier over the votes' counts is trained on the posterior labels, and scores every
   text.

Learning sees labelled rows with crc32(doc_id) mod 3 <> 1 alone, at most `most_rows` of them, drawn by
a digest of doc_id: the bound on what reaches the driver is votes of `most_rows` rows. Scoring
reads whole texts, one after another, and moves no row.

Results for odd rows: null and empty texts score as texts without votes; without labelled toxic
rows, the general lexicon alone votes: a single insult raises the score, but not to the cut; rows with null ids are scored and not held out; repeated
rows are scored row by row, and of those that share an id one is learnt from; labels of ids that no
document has are ignored; an empty table gives no rows; texts of any length are read whole, and
columns other than doc_id, text and labels' doc_id and toxic are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .hashing import spans, word_hashes

MOST_ROWS, MOST_MINED, LEAST_G2, LEAST_PURE, CUT, TIED, LEAST_ODDS, LEAST_CONTEXTS = 20_000, 1500, 20.0, 0.995, 0.7, 0.3, 3.0, 5
#: Lengths, in bytes, of the word beginnings that can become voters.
BEGINNINGS = (4, 5, 6)
#: Common insults of four languages.
LEXICON = {
    "insult_person": "idiot idiots moron morons loser losers clown clowns imbecile fool scum bastard jerk creep".split(),
    "insult_quality": "stupid dumb pathetic worthless disgusting ugly filthy useless trash garbage vile".split(),
    "abuse_de": "dummkopf trottel abschaum idiotisch wertlos ekelhaft arschloch".split(),
    "abuse_fr": "imbécile crétin ordure connard débile dégoûtant salaud".split(),
    "abuse_es": "estúpido imbécil basura escoria asqueroso tonto inútil".split(),
}
SPLIT = np.full(256, 32, np.uint8)
SPLIT[97:123] = np.arange(97, 123)
SPLIT[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_features(texts: list[str]):
    """(text, hash, hash of the word before) of all words and word beginnings."""
    data = SPLIT[np.frombuffer("\n".join(t.lower() for t in texts).encode(), np.uint8)]
    limits = np.cumsum([len(t.lower().encode()) + 1 for t in texts])
    starts, ends = spans(data)
    owner = np.searchsorted(limits, starts, "right")
    words = word_hashes(data, starts, ends)
    before = np.concatenate((np.zeros(1, np.uint64), words))[: len(words)]
    yield owner, words, before
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        yield owner[long], word_hashes(data, starts[long], starts[long] + k) ^ np.uint64(k << 32), before[long]


def word_key(word: str) -> int:
    data = SPLIT[np.frombuffer(word.encode(), np.uint8)]
    return int(word_hashes(data, *spans(data))[0])


def groups(texts: pa.Array, least: int = 1 << 20):
    """The texts, about `least` characters at a time."""
    release()
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= least:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Model:
    """keys: sorted hashes; voter: of each key; weights: of log(1 + votes) by voter, then of 'any
    strong voter'."""

    keys: np.ndarray
    voter: np.ndarray
    weights: np.ndarray
    bias: float
    strong: np.ndarray

    @property
    def n(self) -> int:
        return len(self.weights) - 1

    def votes(self, texts: list[str]) -> np.ndarray:
        """Times that each voter fires in each text; the last two voters are the patterns."""
        out = np.zeros((len(texts), self.n), np.float32)
        for owner, hashes, _ in text_features(texts):
            if len(self.keys) and len(hashes):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == hashes)
                np.add.at(out, (owner[hit], self.voter[at[hit]]), 1)
        out[:, -2:] = np.array([patterns(t) for t in texts], np.float32).reshape(-1, 2)
        return out

    def inputs(self, votes: np.ndarray) -> np.ndarray:
        return np.column_stack((np.log1p(votes), (votes[:, self.strong] > 0).any(1)))

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(votes) @ self.weights + self.bias, -30, 30)))


def patterns(text: str) -> tuple[bool, bool]:
    """Shouting: mostly capitals; and many exclamation marks for its words."""
    return text.isupper(), text.count("!") * 4 > text.count(" ") + 4


def mined(sample: DataFrame) -> list[tuple[int, int, int]]:
    """(hash, toxic rows, clean rows) of the features most tied to toxic rows of sample(text, toxic).
    All features are counted and tested where they are; only those that stay reach the driver."""

    def counted(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy() == 1
            texts = batch.column("text")
            for part, bad in ((p, b) for b in (True, False) for p in groups(texts.filter(pa.array(toxic == b)))):
                owner, keys, before = (np.concatenate(x) for x in zip(*text_features(part), strict=True))
                order = np.lexsort((owner, keys))
                owner, keys, bit = owner[order], keys[order], np.left_shift(np.uint64(1), before[order] % np.uint64(63))
                if not len(keys):
                    continue
                new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))).astype(np.int64)
                n, contexts = np.add.reduceat(once, new), np.bitwise_or.reduceat(bit, new).view(np.int64)
                yield pa.record_batch({"f": pa.array(keys[new].view(np.int64)), "p": pa.array(n * bad), "q": pa.array(n * (not bad)), "c": pa.array(contexts * bad)})

    total = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()[0]
    if not total["p"] or total["p"] == total["n"]:
        return []
    by = sample.select("text", "toxic").mapInArrow(counted, "f long, p long, q long, c long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.bit_count(F.bit_or("c")).alias("contexts"))
    rate = total["p"] / total["n"]
    p, q = F.col("p"), F.col("q")
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((p + q) * F.lit(share)))).otherwise(0.0)
    good = by.where((p >= 3) & (F.col("contexts") >= LEAST_CONTEXTS)).withColumn("g2", 2 * (part(p, rate) + part(q, 1 - rate)))
    good = good.where((F.col("g2") >= LEAST_G2) & (p >= LEAST_PURE * (p + q))).orderBy(F.desc("g2"), "f").limit(MOST_MINED)
    return [(r["f"], r["p"], r["q"]) for r in good.collect()]


def label_model(fired: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 votes, and each voter's log odds. A voter that doesn't fire abstains, which
    says nothing; that no strong one fires is a vote of its own."""
    votes = np.column_stack((fired, ~fired.any(1))).astype(np.float64)
    odds = None
    post, prior = np.where(labels > 0, 0.95, 0.02), float(np.clip(labels.mean(), 0.01, 0.99))
    group = np.arange(votes.shape[1])
    for r in range(rounds):
        one, zero = post.sum(), (1 - post).sum()
        if odds is not None:
            votes[:, -1] = ~fired[:, odds[:-1] > LEAST_ODDS].any(1)
        a = np.clip((post @ votes + 0.5) / (one + 1), 1e-4, 1 - 1e-4)
        b = np.clip(((1 - post) @ votes + 0.05) / (zero + 1), 1e-5, 1 - 1e-4)
        if r == 5:
            # Correlation of the votes left over once the class is known.
            rest = votes - post[:, None] * a - (1 - post)[:, None] * b
            sd = np.sqrt((rest * rest).mean(0)) + 1e-9
            tied = (rest.T @ rest) / len(votes) / np.outer(sd, sd) > TIED
            for _ in range(len(group)):
                low = np.where(tied, group[None, :], len(group)).min(1)
                if (np.minimum(low, group) == group).all():
                    break
                group = np.minimum(low, group)
        odds = np.log(a / b)
        evidence = sum(np.where(votes[:, group == g] > 0, odds[group == g], -np.inf).max(1).clip(-20) * (votes[:, group == g] > 0).any(1) for g in np.unique(group))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, odds[:-1]


def classifier(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # The broadcast has most_rows rows of 12 bytes; the sample is read three times, the corpus once.
    # Of rows that share an id the one with the smallest text is sampled, so that rows are bounded too.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = Scratch(docs.sparkSession, "toxicity").put(sample, "sample")
    found = mined(sample)
    order = sorted({w for ws in LEXICON.values() for w in ws})
    names: dict[int, str] = {word_key(w): w for w in order}
    # Each strong feature votes alone; the many weaker ones share voters by their strength.
    for rank, (f, p, _) in enumerate(found):
        name = f"mined-{rank}" if rank < 96 else f"mined-rest-{min(9, int(np.log2(p)))}"
        names.setdefault(int(np.int64(f).view(np.uint64)), name)
        if name not in order:
            order.append(name)
    keys = np.array(sorted(names), np.uint64)
    order += ["shouting", "exclaiming"]
    model = Model(keys, np.array([order.index(names[int(k)]) for k in keys], np.int64), np.zeros(len(order) + 1), 0.0, np.arange(len(order)) < len(order) - 2)
    if not found:
        model.weights[:-3], model.weights[-1], model.bias = 1.0, 3.0, -3.0
        return model

    def run(batches):
        for batch in batches:
            got = [model.votes(part) for part in groups(batch.column("text"))]
            if got:
                v = np.concatenate(got)
                yield pa.record_batch({"v": pa.array([r.tobytes() for r in np.minimum(v, 255).astype(np.uint8)], pa.binary()), "toxic": batch.column("toxic").cast(pa.int64())})

    rows = sample.select("text", "toxic").mapInArrow(run, "v binary, toxic long").collect()
    votes = np.frombuffer(b"".join(r["v"] for r in rows), np.uint8).reshape(len(rows), -1).astype(np.float64)
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    order_ = np.lexsort((toxic, *votes.T))  # so that sums don't depend on the order of arrival
    votes, toxic = votes[order_], toxic[order_]
    post, odds = label_model(votes > 0, toxic)
    model.strong = odds > LEAST_ODDS
    w = classifier(model.inputs(votes), post)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns of docs with `score`; docs needs text. No row moves."""
    schema = docs.select(*columns).schema.add("score", "double")
    need = [*columns, *[c for c in ("text",) if c not in columns]]

    def run(batches):
        for batch in batches:
            got = [model.scores(model.votes(part)) for part in groups(batch.column("text"))]
            yield batch.select(columns).append_column("score", pa.array(np.concatenate(got) if got else np.empty(0), pa.float64()))

    return docs.select(*need).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text)."""
    out = scored(docs, fit(docs, labels, most_rows), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
