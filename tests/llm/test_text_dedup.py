import random
from types import SimpleNamespace

import brute
import numpy as np
import pytest

from quillspark.llm import blocks, near_dup, substring, suffixes

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def made():
    """Copies, near copies with edits, shared passages, short, empty, null and long texts."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, base = [], [text(r.randint(1, 300)) for _ in range(30)]
    for b in base:
        rows += [b] * r.randint(1, 4)
        for _ in range(r.randint(0, 6)):
            w = b.split()
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
    passage = text(60)
    rows += [text(20) + " " + passage + "\n" + text(9) for _ in range(12)]
    rows += [None, "", "   \n", "one", "One", "one two", "x" * 400, "y" * 49, "A B c d", "a b C D", " ".join(["la"] * 90), text(20_000)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in made()], "doc_id long, text string, n string, block int")


def test_near_duplicates(spark, docs):
    got = rows_of(near_dup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dup(made()), key=repr)


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(near_dup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dup([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_buckets_that_disagree_are_compared_in_full(spark):
    """A chain of drifting copies, in which few are near the smallest."""
    r = random.Random(8)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[r.randrange(200)] = f"n{r.randrange(10**6)}"
    got = rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dup(rows), key=repr)


def test_merged_registers_are_those_of_the_union():
    a, b = near_dup.shingle_sets([b"a b c d e f g h i", b"e f g h i j k l m n"])
    import numpy as np

    r = near_dup.registers([a, b, np.union1d(a, b)])
    assert (near_dup.merge(r[0], r[1]) == r[2]).all()


def test_suffixes(spark, docs):
    got = rows_of(suffixes.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffixes(made()), key=repr)


def test_substring(spark, docs):
    got = rows_of(substring.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(made()), key=repr)


@pytest.mark.parametrize("run", [near_dup.near_duplicates, suffixes.digest, substring.digest])
def test_empty_table_null_ids_and_repeated_rows(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same = " ".join(f"w{k}" for k in range(60))
    got = run(spark.createDataFrame([(None, same), (1, same), (1, same), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 1, 2, None]


def test_repeated_rows_lose_their_windows_and_null_ids_come_last(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(None, same), (1, same), (1, same)], "doc_id long, text string")
    assert {r.n_removed for r in substring.digest(rows).collect()} == {60}
    assert sorted((str(r.doc_id), r.n_removed) for r in suffixes.digest(rows).collect()) == [("1", 0), ("1", 0), ("None", len(same))]


def test_suffixes_are_exact_whatever_the_fingerprints(monkeypatch):
    """All fingerprints clash: bytes alone decide. Two blocks and one bucket, without Spark."""
    monkeypatch.setattr(suffixes.Places, "fingerprints", lambda self: np.zeros(len(self.at), np.uint64))
    rows = [(i, (t or "").encode()) for i, t in made() if len(t or "") < 2000]
    r = random.Random(5)
    passage = bytes(r.choice(b"abcdef") for _ in range(90))
    rows += [(len(rows) + 500 + k, "".join(r.choice("ab") for _ in range(300)).encode() + passage[k : k + 70]) for k in range(12)]
    parts = [SimpleNamespace(texts=[t for _, t in part], numbers=np.array([i for i, _ in part], np.int64)) for part in (rows[::2], rows[1::2])]
    every = SimpleNamespace(bits=lambda keys: np.ones(len(keys), bool))
    sent = []
    for b in parts:
        _, new, _, contexts, docs = suffixes.Places(b, 50).contexts(every)
        sent.append((suffixes.with_documents(contexts[new], docs[new]), int(new.sum())))
    got = suffixes.smaller([x for x, _ in sent], [n for _, n in sent], 50)
    out = {}
    for b, bits in zip(parts, got, strict=True):
        p = suffixes.Places(b, 50)
        flags = p.covered_by(bits, *p.contexts(every))
        for i, t, x, y in zip(b.numbers.tolist(), b.texts, p.limits[:-1], p.limits[1:], strict=True):
            out[i] = (len(t), int(flags[x:y].sum()))
    assert out == {i: (n, gone) for i, n, gone, *_ in brute.suffixes([(i, t.decode()) for i, t in rows])}


def test_suffixes_in_an_odd_number_of_buckets(spark, docs, monkeypatch):
    """No bucket lies in two of the shares that are sorted one after another."""
    monkeypatch.setattr(blocks, "LEAST", 7)
    got = rows_of(suffixes.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffixes(made()), key=repr)
    for n in (1, 7, 64, 999):
        edge = np.array([blocks.first_key(k, n) for k in range(n)], np.uint64)
        assert blocks.buckets(edge, n).tolist() == list(range(n)) and blocks.buckets(edge[1:] - np.uint64(1), n).tolist() == list(range(n - 1))


def test_ranks_are_those_of_sorted_rows():
    r = np.random.default_rng(4)
    for width, letters in ((1, 3), (9, 2), (30, 2), (17, 250)):
        data = r.integers(0, letters, (500, width)).astype(np.uint8)
        order, new = suffixes.ranked(suffixes.columns_of(data))
        rows = [bytes(x) for x in data]
        assert order.tolist() == sorted(range(500), key=lambda k: rows[k])
        assert int(new.sum()) == len(set(rows))
