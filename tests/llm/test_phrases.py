import random
import re
from collections import Counter

import brute
import pytest

from quillspark.llm import phrases

COLUMNS = "lang rank phrase a l r n score".split()


def plain(rows, least, top):
    """Every phrase is counted, none pruned."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.UP)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    held = Counter()
    for (lang, w), a in many.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                held[lang, w[i : i + size]] = max(held[lang, w[i : i + size]], a)
    found = []
    for (lang, w), a in many.items():
        if held[lang, w] < a:
            score, _, x, y = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.append((lang, -score, -a, " ".join(w).encode(), x, y, n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, x, y, total in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, x, y, total, -score))
    return sorted(out)


def made():
    r = random.Random(9)
    words = ["new", "York", "city", "é", "of", "the", "😀", "x\x00y", "San", "Francisco", *[f"w{k}" for k in range(40)]]
    gap = lambda: r.choice((" ",) * 8 + ("  ", "\t", ". ", ",", "\n", " ; ", "\x0b"))
    text = lambda n: "".join((r.choice(("new york city", "San Francisco", "of the")) if r.random() < 0.3 else r.choice(words)) + gap() for _ in range(n))
    rows = [(r.choice(("en", "de", None, "und", "")), text(r.randint(0, 60))) for _ in range(250)]
    return rows + [("en", None), (None, ""), ("en", " . , "), ("fr", text(20_000)), ("long", "z" * 300_000 + " " + "z" * 300_000)] + [("en", "One repeated row, one repeated row.")] * 40


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(lang, t, 1, "clash", 7) for lang, t in made()], "lang string, text string, doc_id int, phrase string, n int")


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases(docs, top):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, least=5, top=top).collect())
    want = plain(made(), 5, top)
    assert got == want and len(want) > 20


def test_products_beyond_64_bits(spark):
    big = 9 * 10**15
    total = spark.createDataFrame([("en", 8 * 10**16 + 1)], "lang string, n long")
    found = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 7, 1), ("en", "a b", big, 2)], "lang string, phrase string, f long, k int")
    r = phrases.scored(total, found).collect()[0]
    assert r.score == 1000 * big * (8 * 10**16 + 1) // ((big + 1) * (big + 7))


def test_empty(docs):
    assert phrases.collocations(docs.where("false")).collect() == []


def test_filter_holds_every_frequent_phrase(spark):
    import numpy as np

    rows = [("en", f"p{k} q{k}") for k in range(500)]
    bits = np.frombuffer(phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"), 2), np.uint8)
    assert len(bits) == 1 << (phrases.FILTER_BITS - 3) and 450 < np.unpackbits(bits).sum() <= 500
