import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import library as L
from quillspark.operators import matching as M

ENTRY = "pos int, key string, doi string, title string, author string, year string"


def pairs(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ENTRY)
    return sorted(tuple(r) for r in L.duplicate_pairs(df).collect())


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([("a", "10.1/X", "T", "A", "1"), ("b", "10.1/x", "U", "B", "2")], [("a", "b")]),
        ([("a", "10.1/x", "A title!", "A", "1"), ("b", "10.2/y", "a Title", "B", "2")], [("a", "b")]),
        ([("a", "", "T", "Doe,  J", "2001"), ("b", None, "U", "doe, j", "2001")], [("a", "b")]),
        ([("a", None, "T", "Doe", None), ("b", None, "U", "Doe", None)], []),
        ([("a", "1", "", "", ""), ("b", "1", "", "", ""), ("c", "1", "", "", "")], [("a", "b"), ("a", "c"), ("b", "c")]),
        ([("a", "1", "", "", ""), ("a", "2", "", "", ""), ("b", "1", "", "", "")], []),
    ],
)
def test_duplicates(spark, rows, wanted):
    assert pairs(spark, *rows) == wanted


def test_duplicates_join_by_hash_or_sort(spark):
    df = spark.createDataFrame([(0, "a", "1", "t", "x", "1")], ENTRY)
    plan = L.duplicate_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and " OR " not in plan


def some_entries(spark):
    rows = [(i, f"k{i % 53}", ["", None, f"10.1/{i % 7}"][i % 3], f"T {i % 5}" if i % 4 else "", f"A{i % 3}", str(i % 2) if i % 5 else None) for i in range(60)]
    last = {r[1]: r for r in rows}
    same = lambda a, b: any(x and x == y for x, y in zip([a[2], a[3], a[5] and (a[4], a[5])], [b[2], b[3], b[5] and (b[4], b[5])], strict=True))
    return spark.createDataFrame(rows, ENTRY), sorted((a, b) for a in last for b in last if a < b and same(last[a], last[b]))


def test_duplicates_come_once_without_being_held(spark):
    df, wanted = some_entries(spark)
    got = L.duplicate_pairs(df)
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_duplicates_are_counted_without_pairs(spark):
    df, wanted = some_entries(spark)
    got = L.duplicate_count(df)
    assert got.collect()[0].n == len(wanted) > 100
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert L.duplicate_count(df.limit(0)).collect()[0].n == 0


def test_places_of_duplicates_are_known_without_ranking_the_pairs(spark):
    df, wanted = some_entries(spark)
    got = L.ordered_duplicates(df)
    assert sorted((r.key1, r.key2, r.place) for r in got.collect()) == [(*p, n + 1) for n, p in enumerate(wanted)]
    assert not re.search(r"key1#\d+ ASC", got._jdf.queryExecution().optimizedPlan().toString())


def test_order_of_citations(spark):
    lib = spark.createDataFrame([(0, "k1"), (1, "k2"), (2, "k3"), (3, "big")], "pos int, key string")
    cited = spark.createDataFrame([(1, "k2"), (2, "k1"), (3, "k2"), (10000, "big"), (4, "lost")], "ord int, key string")
    got = {r.key: (r.cite_order, r["rank"]) for r in L.sync(lib, cited).collect()}
    assert got == {"k1": (2, 1), "k2": (3, 2), "k3": (None, 3), "big": (10000, 4)}
    assert [r.key for r in L.missing_refs(cited, lib).collect()] == ["lost"]
    assert {r.key for r in L.cited_only(lib, cited).collect()} == {"k1", "k2", "big"}


def test_numeric_text_orders(spark):
    lib = spark.createDataFrame([(0, "a", "10"), (1, "b", "2"), (2, "c", "1"), (3, "d", None)], "pos int, key string, cite_order string")
    assert [r.key for r in L.in_cite_order(lib).orderBy("rank").collect()] == ["c", "b", "a", "d"]


def test_reuse_takes_the_first_entry(spark):
    lib = spark.createDataFrame([(1, "late", "10.1/AB", "", ""), (0, "url", "", "https://E.org/a/?utm_x=1", ""), (2, "again", "10.1/ab", "", ""), (3, "pre", "", "", "2106.12345")], "pos int, key string, doi string, url string, eprint string")
    ids = spark.createDataFrame([("doi:10.1/ab",), ("https://e.org/a",), ("2106.12345v1",), ("none",)], "id string")
    assert {r.id: r.key for r in L.reuse(ids, lib).collect()} == {"doi:10.1/ab": "late", "https://e.org/a": "url", "2106.12345v1": "pre"}


def test_issues(spark):
    i = lambda *v: spark.range(1).select(L.issues(*[F.lit(x).cast("string") for x in v]).alias("i")).collect()[0].i
    assert i("A", "", None, "", None, "") == ["title", "journal or year", "doi or url"]
    assert i("A", "T", None, "2000", None, "u") == []


def test_keys_get_suffixes(spark):
    rows = spark.createDataFrame([(k, "Doe, J and X", "2020", "Some title") for k in range(8)] + [(9, None, None, "")], "pos int, author string, year string, title string")
    got = [r.citekey for r in L.citation_keys(rows).orderBy("pos").collect()]
    assert got == ["Doe2020Sometit", *[f"Doe2020Sometit{s}" for s in "abcde"], "Doe2020Sometit1", "Doe2020Sometit2", "Unknown2024Paper"]


def test_set_field_and_upsert(spark):
    lib = spark.createDataFrame([("a", "10.1/a", {"x": "1"})], "key string, doi string, fields map<string,string>")
    assert L.set_field(lib, "cite_order", F.lit("3")).collect()[0].fields == {"x": "1", "cite_order": "3"}
    assert L.set_field(lib, "x", F.lit(None).cast("string")).collect()[0].fields == {}
    new = spark.createDataFrame([("b", "https://doi.org/10.1/A", {}), ("c", "10.2/c", {})], lib.schema)
    assert sorted(r.key for r in L.upsert(lib, new).collect()) == ["a", "c"]


def test_ranking_gates_on_anchors(spark):
    s = spark.createDataFrame([(1, "Superconducting qubits couple to phonons at 5.0 GHz")], "sent_id int, sentence string")
    c = spark.createDataFrame([(0, "other", "Plant growth at 5.1 GHz", None, None), (1, "hit", "A superconducting qubit", "with phonon modes", "J"), (2, "none", None, None, "Botany")], "pos int, cite_key string, title string, abstract string, journal string")
    got = M.rank(s, c, None).collect()
    assert [(r.cite_key, r.anchor_matches, r["rank"]) for r in got] == [("hit", 3, 1)] and got[0].score > 0


def all_pairs(s, c):
    """Every pair that scores, by the scores themselves."""
    from quillspark.functions import scores as S

    a, b = M.prepared_sentences(s), M.prepared_candidates(c)
    anchor = S.anchored(F.col("s_anchors"), F.col("title"), F.col("hay"))
    total = S.overlap(F.col("s_terms"), F.col("c_terms")) + S.quantitative(*map(F.col, ("s_topics", "s_claims", "hay", "c_numbers", "c_topics"))) + anchor["score"]
    total = F.when((F.size("s_anchors") > 0) & (anchor["matched"] == 0), 0.0).otherwise(total)
    return {(r.sent_id, r.pos): r.score for r in a.crossJoin(b).select("sent_id", "pos", F.round(total, 4).alias("score")).where("score > 0").collect()}


SENTENCE, CANDIDATE = "sent_id int, sentence string", "pos int, cite_key string, title string, abstract string, journal string"


def test_ranking_equals_all_pairs(spark):
    """The token join finds every pair that scores."""
    s = spark.createDataFrame([(0, "It rose 12% in 3.0 K"), (1, "strain and 7 things"), (2, "alpha beta gamma"), (3, "at 1000 m")], SENTENCE)
    c = spark.createDataFrame([(k, f"c{k}", t, "", "") for k, t in enumerate(["gamma ray", "up to 12.5", "strained", "1070 metres", "3.14", "zzz"])], CANDIDATE)
    joined = {(r.sent_id, r.pos): r.score for r in M.rank(s, c, None).collect()}
    assert joined == all_pairs(s, c) and len(joined) > 4


def made_pairs(spark):
    import random

    r = random.Random(6)
    words = "phonon qubit acoustic strain modulation 3 K 3.2 K 12 % 5 GHz 40 m the 7 things laser crystal tc critical temperature alpha beta gamma delta 1000 nm superconducting film".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    s = spark.createDataFrame([(k, text(r.randint(1, 14))) for k in range(150)] + [(900, ""), (901, None), (902, text(4)), (903, "5 m")], SENTENCE)
    c = spark.createDataFrame([(k, f"c{k}", text(r.randint(0, 5)) if k % 9 else None, text(r.randint(0, 20)), None) for k in range(90)] + [(90, "c90", "Étude à 5 µm", "", "")], CANDIDATE)
    return s, c


@pytest.mark.parametrize("heavy", [0, 10, 10**6])
def test_best_candidates_whatever_tokens_are_frequent(spark, heavy):
    s, c = made_pairs(spark)
    scores = all_pairs(s, c)
    want = {}
    for (i, pos), x in sorted(scores.items(), key=lambda e: (e[0][0], -e[1], e[0][1])):
        want.setdefault(i, []).append((pos, x))
    got = {}
    for row in M.rank(s, c, 3, heavy).orderBy("sent_id", "rank").collect():
        got.setdefault(row.sent_id, []).append((row.pos, row.score))
    assert got == {i: v[:3] for i, v in want.items()}


def test_pairs_met_are_few(spark):
    """Every pair that is met scores; with frequent tokens a sentence meets little more than its best."""
    s, c = made_pairs(spark)
    a, b = M.prepared_sentences(s), M.prepared_candidates(c)
    scores = all_pairs(s, c)
    met = {(r.sent_id, r.pos) for r in M.met(a, b, None).collect()}
    assert met == set(scores)
    assert M.met(a, b, 3, 0).count() <= 3 * len({i for i, _ in scores})


def test_best_evidence(spark):
    c = spark.createDataFrame([(0, "Phonon lasers", "Phonon lasers have attracted great attention in recent years. Here we demonstrate a phonon laser with low noise at room temperature."), (1, "Only a title", None)], "pos int, title string, abstract string")
    got = {r.pos: r for r in M.best_evidence(c).collect()}
    assert got[0].best_evidence.startswith("Here we demonstrate") and got[0].reference_note.startswith("Phonon lasers. Here")
    assert (got[1].best_evidence, got[1].reference_note) == ("Only a title", "Only a title")


def test_first_source(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 1, "z"), (2, 3, "w")], "id int, tier int, n string")
    assert sorted(r.n for r in M.first_source(rows, "id", "tier").collect()) == ["w", "y", "z"]


def sequential(bases, existing):
    used, out = set(existing), []
    for b in bases:
        for s in ["", *"abcde", *map(str, range(1, 9999))]:
            if b + s not in used:
                break
        used.add(b + s)
        out.append(b + s)
    return out


def test_keys_are_those_of_a_sequential_pass(spark):
    """Bases that are another's suffixed form, chains of them, and keys that exist before."""
    import random

    r = random.Random(3)
    titles = [r.choice(["X", "Xa", "Xab", "X1", "X12", "X1a", "Y", "Ye", "Z"]) for _ in range(90)]
    rows = spark.createDataFrame([(i, "Doe, J", "2001", t) for i, t in enumerate(titles)], "pos int, author string, year string, title string")
    existing = spark.createDataFrame([("Doe2001Xb",), ("Doe2001Z",), ("Doe2001Y3",), ("other",)], "key string")
    got = {x.pos: x.citekey for x in L.citation_keys(rows, existing).collect()}
    assert [got[i] for i in range(90)] == sequential([f"Doe2001{t}" for t in titles], ["Doe2001Xb", "Doe2001Z", "Doe2001Y3", "other"])
    assert len(set(got.values())) == 90


def test_upsert_adds_one_of_new_rows_that_share_a_doi_or_key(spark):
    have = spark.createDataFrame([(0, "k0", "10.1/Z")], "pos int, key string, doi string")
    new = spark.createDataFrame([(1, "a", "10.1/A"), (2, "b", "https://doi.org/10.1/a"), (3, "c", ""), (4, "c", None), (5, "k0", "10.1/q"), (6, "d", "10.1/z")], "pos int, key string, doi string")
    assert sorted(x.key for x in L.upsert(have, new).collect()) == ["a", "c", "k0"]


def test_duplicate_groups_say_what_pairs_say(spark):
    df = spark.createDataFrame([(i, f"k{i}", "10.1/x" if i < 50 else "", f"t{i % 40}", "A", None) for i in range(80)], ENTRY)
    got = L.duplicate_groups(df).collect()
    assert {(r.representative, r.n) for r in got if r.kind == "doi"} == {("k0", 50)} and sum(r.kind == "title" for r in got) == 80
    assert [r.place for r in L.ordered_duplicates(df).orderBy("key1", "key2").collect()] == list(range(1, L.duplicate_pairs(df).count() + 1))


def test_an_order_that_is_no_integer_is_an_error(spark):
    lib = spark.createDataFrame([(0, "a", "x")], "pos int, key string, cite_order string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        L.in_cite_order(lib).collect()


def test_free_suffixes_of_one_base(spark, monkeypatch):
    """One base holds all rows, and existing keys leave gaps; places are counted in many ranges."""
    import random

    r = random.Random(7)
    n = 3000
    existing = sorted({"Doe2001X" + x for x in ["", "c", "e", "01", "0", "f", *[str(r.randrange(1, 2500)) for _ in range(400)]]})
    rows = spark.createDataFrame([(i * 3, "Doe, J", "2001", "X") for i in range(n)], "pos long, author string, year string, title string")
    narrow = L.ranked_within
    monkeypatch.setattr(L, "ranked_within", lambda *a: narrow(*a, width=6))
    got = {x.pos: x.citekey for x in L.citation_keys(rows, spark.createDataFrame([(x,) for x in existing], "key string")).collect()}
    assert got == dict(zip(range(0, 3 * n, 3), sequential(["Doe2001X"] * n, existing), strict=True))


def test_meeting_bases_without_existing_keys(spark):
    titles = ["X", "X1", "X1", "Xa", "X", "X", "X1b", "Y"] * 5
    rows = spark.createDataFrame([(i, "Doe, J", "2001", t) for i, t in enumerate(titles)], "pos int, author string, year string, title string")
    assert {x.pos: x.citekey for x in L.citation_keys(rows).collect()} == dict(enumerate(sequential([f"Doe2001{t}" for t in titles], [])))


def test_global_ranks(spark):
    """Ties, one order that holds most rows, and text keys, in many ranges."""
    import random

    r = random.Random(5)
    rows = [(r.choice((7, 7, 7, r.randrange(10**6))), f"k{r.randrange(5000)}é", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, k string, i int")
    for keys, want in ((["a", "i"], sorted((a, i) for a, _, i in rows)), (["k", "i"], sorted((k.encode(), i) for _, k, i in rows))):
        got = {x.i: x.place for x in L.global_rank(df, keys, "place", ranges=37).collect()}
        assert got == {i: n for n, (_, i) in enumerate(want, 1)}
    assert L.global_rank(df.where("false"), ["a"], "place").collect() == []


def test_ranges_of_a_global_rank_are_even(spark):
    """At 10**6 distinct orders no task gets more than twice the median."""
    import statistics

    df = spark.range(1_000_000).select((F.col("id") * F.col("id") % 1_000_003).alias("a"), F.col("id").alias("pos"))
    cuts = L.cut_points(df, ["a", "pos"], 64)
    sizes = [x["count"] for x in df.withColumn("r", L.range_of(df, ["a", "pos"], cuts)).groupBy("r").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 2 * statistics.median(sizes)


def test_ranks_after_a_union_are_exact(spark):
    """Adaptive execution may treat a union's inputs differently from one run to the next."""
    source = spark.range(1000).select((F.col("id") % 7).cast("string").alias("author"), F.lit("2001").alias("year"), F.lit("x").alias("title"), F.col("id").alias("pos"))
    keys = L.citation_keys(source, source.select(F.concat("author", F.lit("2001x"), (F.col("pos") % 50).cast("string")).alias("key")))
    assert {len(keys.select("citekey", "pos").collect()) for _ in range(4)} == {1000}
