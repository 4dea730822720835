"""Toxicity and embeddings: held-out accuracy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import embedding, toxicity


def toxic_rows(n=900):
    r = np.random.default_rng(4)
    common = [f"w{k}" for k in range(300)]
    bad = ["idiot", "scum", *[f"zorg{x}" for x in ("a", "eld", "ian", "uth", "omp", "ing")]]
    rows, labels = [], []
    for i in range(n):
        words = [common[k] for k in r.integers(0, 300, 40)]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                words.insert(r.integers(0, len(words)), bad[r.integers(0, len(bad))])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = toxic_rows()
    odd = [(9001, None), (9002, ""), (None, "w1 idiot scum idiot"), (9003, "w1 w2 zorgnew w3 zorgelse")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    test = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(test) > 200 and all(r.predicted == truth[r.doc_id] for r in test)
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score < 0.3 and by[None].predicted == 1 and by[9003].predicted == 1
    assert not by[None].held_out and all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello there")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()}
    assert scores[1][0] > scores[2][0] and {i: p for i, (_, p) in scores.items()} == {1: 0, 2: 0}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_held_out_rows_are_never_learned_from(spark):
    rows, labels = toxic_rows(300)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (known, flipped))
    assert a == b


def vectors():
    r = np.random.default_rng(7)
    x = [r.standard_normal(16) for _ in range(400)]
    for base in range(12):
        x += [x[base] + r.standard_normal(16) * 0.08 for _ in range(5 * base)]
    x += [x[3].copy() for _ in range(4)]
    return [v.tolist() for v in x]


def test_embedding_links_against_brute_force(spark):
    x = vectors()
    rows = [(i, v) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding.embedding_duplicates(df).collect()}
    m = np.array(x)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = (m @ m.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= linked).all() and found.sum() >= 0.95 * linked.sum()
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_equal_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(5, [1.0, 1.0]), (3, [1.0, 1.0]), (9, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.embedding_duplicates(df).collect()} == {5: (1, 3, False), 3: (1, 3, True), 9: (0, 9, True)}
    assert embedding.embedding_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 7, 300])
def test_lists_hold_the_nearest(n):
    x = np.random.default_rng(n).standard_normal((n, 8))
    a, b, s = embedding.nearest(np.arange(n), x, 3)
    for i in range(n):
        sims = x @ x[i]
        sims[i] = -np.inf
        assert sorted(s[a == i], reverse=True) == pytest.approx(sorted(sims, reverse=True)[: min(3, n - 1)])


def run_embeddings(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return {r.vec_id: r for r in embedding.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}


def near(r, base, cosine):
    """A vector at this cosine to base."""
    base = base / np.linalg.norm(base)
    side = r.standard_normal(len(base))
    side -= side @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_pairs_beside_a_dense_component(spark):
    r = np.random.default_rng(3)
    middle, clutter = r.standard_normal(64), r.standard_normal((4000, 64))
    x = np.array([near(r, middle, 0.97) for _ in range(2000)] + list(clutter) + [near(r, c, 0.905) for c in clutter[:400]])
    got = run_embeddings(spark, x)
    found = [got[2000 + i].n_links >= 1 and got[2000 + i].component_id == got[6000 + i].component_id for i in range(400)]
    assert np.mean(found) >= 0.97


def test_tight_subgroups_with_cross_links(spark):
    r = np.random.default_rng(5)
    a = r.standard_normal(64)
    b = near(r, a, 0.95)
    x = np.array([near(r, base, 0.998) for base in (a, b) for _ in range(100)])
    got = run_embeddings(spark, x)
    assert all(v.n_links == 199 and v.component_id == 0 for v in got.values()) and sum(v.kept for v in got.values()) == 1


def test_audit_counts_each_linked_probe_once(spark):
    truth = spark.createDataFrame([(0, 5000), (1, 4000), (2, 1), (3, 2)], "rep long, linked long")
    counts = spark.createDataFrame([(0, 5000), (1, 2000), (3, 1), (7, 1)], "rep long, linked long")
    assert embedding.audited(truth, truth) == {"few": (2, 1.0), "many": (2, 1.0)}
    assert embedding.audited(truth, counts) == {"few": (2, 0.25), "many": (2, 0.75)}
    assert embedding.audited(truth.limit(0), counts) == {}


def test_rare_links_are_searched_and_audited(spark, monkeypatch):
    """Few vectors with links: the search finds them, without comparing all with all."""
    monkeypatch.setattr(embedding, "exact", lambda *a: pytest.fail("all were compared with all"))
    r = np.random.default_rng(11)
    clutter = r.standard_normal((6000, 64))
    x = np.array(list(clutter) + [near(r, c, 0.93) for c in clutter[:40]])
    got = run_embeddings(spark, x)
    found = [got[i].n_links == 1 == got[6000 + i].n_links and got[6000 + i].component_id == i for i in range(40)]
    assert np.mean(found) >= 0.95 and sum(v.n_links for v in got.values()) <= 80
    assert len(embedding.last_audit) <= embedding.GOES and all(q >= embedding.AIM for _, q in embedding.last_audit[-1].values())


def test_exact_search_where_the_aim_is_missed(spark, monkeypatch):
    monkeypatch.setattr(embedding, "AIM", 1.1)
    monkeypatch.setattr(embedding, "GOES", 1)
    monkeypatch.setattr(embedding, "EXACT", 50)
    x = np.array(vectors())
    got = run_embeddings(spark, x)
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i].n_links for i in range(len(x))] == ((m @ m.T >= 0.9).sum(1) - 1).tolist()


def sample_with(spark, toxic, clean):
    """Rows of frequent words; `zorg` in the first so many toxic and clean rows of 150 and 600."""
    r = np.random.default_rng(8)
    rows = []
    for bad, n, some in ((1, 150, toxic), (0, 600, clean)):
        for i in range(n):
            words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}word" for k in r.integers(0, 300, 40)]
            rows.append((" ".join(words[:20] + ["zorg"] * (i < some) + words[20:]), bad))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_rare_words_of_toxic_rows_are_mined_among_many_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CANDIDATES", 50, raising=False)
    found = {f: (p, q) for f, p, q in toxicity.mined(sample_with(spark, 12, 0))}
    assert found[int(np.uint64(toxicity.word_key("zorg")).view(np.int64))] == (12, 0)


def test_every_length_of_vectors_is_searched(spark):
    """Minority lengths, equal ids, many equal vectors and clashing columns."""
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(60)]
    rows += [(100, [1.0, 2.0, 2.0]), (101, [1.0, 2.0, 2.1]), (102, [-1.0, 0.0, 0.0]), (103, [5.0]), (104, [7.0]), (105, [-7.0]), (106, [1.0, 0.0]), (107, None), (108, [0.0, 0.0])]
    rows += [(200 + k, [3.0, 1.0]) for k in range(300)] + [(9, rows[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, many int")
    got = {}
    for x in embedding.embedding_duplicates(df).collect():
        got.setdefault(x.vec_id, (x.n_links, x.component_id))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for i, v in unit.items():
        if i == 9:
            continue
        near = [j for j, w in rows if w and any(w) and len(w) == len(v) and j != i and float(np.dot(v, unit[j])) >= 0.9]
        assert got[i][0] == len(near), i
    assert (got[100], got[101], got[102], got[103], got[104], got[105]) == ((1, 100), (1, 100), (0, 102), (1, 103), (1, 103), (0, 105))
    assert got[200] == (300, 106) and got[107] == (0, 107) and got[108] == (0, 108)


def test_nodes_never_meet_by_their_length(spark):
    """Blocks are numbered, and probes drawn, where the nodes are: no join deals vectors by length."""
    nodes = spark.range(40).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("many"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("x"), F.lit(2).alias("d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probes = embedding.probes_of(nodes, 40)
        for df in (embedding.exact_links(nodes, 0.9, 4), embedding.true_links(nodes, probes, 0.9, 4), probes):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert probes.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
