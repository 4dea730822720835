import math
import random
import re
from collections import Counter

import brute
import pytest

from quillspark.llm import pii

COLUMNS = "doc_id n_email n_ip n_card n_phone base_sha256 spans".split()
#: The patterns as they are asked for, not as the operator writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CORE = re.compile(r"""["'(\[]*([^\W\d_]{3,40})[.,;:!?)\]"']*""")


def luhn(d):
    sums = [int(x) for x in d[::-1]]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(sums)) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else None, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def terms(side, at, cut_first, cut_last):
    tokens = list(re.finditer(r"[^\x20\x09-\x0D]*", side))
    parts = re.split(r"[\x20\x09-\x0D]", side)
    place = at
    for i, t in enumerate(parts):
        m = CORE.fullmatch(t)
        if m and not (cut_first and i == 0) and not (cut_last and i == len(parts) - 1):
            yield m[1].translate(brute.UP), place + m.start(1), place + m.end(1)
        place += len(t) + 1
    assert tokens


def found(text):
    spans, near = [], set()
    for k, (kind, pattern) in enumerate(BASE.items()):
        all_ = list(re.finditer(pattern, text, re.ASCII))
        edges = [0, *[m.end() for m in all_]], [*[m.start() for m in all_], len(text)]
        for i, m in enumerate(all_):
            if not good(kind, m[0]):
                continue
            value = m[0].translate(brute.UP) if kind == "email" else re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else m[0]
            spans.append((m.start(), k, m.end(), value))
            n = pii.CONTEXT + 1
            left, right = text[edges[0][i] : m.start()], text[m.end() : edges[1][i + 1]]
            for t in [*terms(left[-n:], m.start() - len(left[-n:]), len(left) >= n, False), *terms(right[:n], m.end(), False, len(right) >= n)]:
                near.add((k, value, *t))
    return sorted(spans), near


def plain(rows):
    each = [(i, t or "", *found(t or "")) for i, t in rows]
    n, n_value, n_term, together = len(rows), Counter(), Counter(), Counter()
    for _, t, spans, near in each:
        n_value.update({(k, v) for _, k, _, v in spans})
        n_term.update({m[1].translate(brute.UP) for x in re.split(r"[\x20\x09-\x0D]", t) if (m := CORE.fullmatch(x))})
        together.update({(k, v, w) for k, v, w, _, _ in near})
    known = {p for p, c in together.items() if c >= pii.LEAST_DOCS and n > n_value[p[:2]] and math.log(c * n / n_term[p[2]] / n_value[p[:2]]) / math.log(n / n_value[p[:2]]) >= pii.DISCLOSED}
    out = []
    for i, _, spans, near in each:
        names = [*BASE, "term"]
        base = [(a, k, b) for a, k, b, _ in spans]
        every = sorted({*base, *((a, 4, b) for k, v, w, a, b in near if (k, v, w) in known)})
        text = lambda s: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
        count = Counter(k for _, k, _ in base)
        out.append((i, *[count[k] for k in range(4)], brute.sha(text(base).encode()), text(every)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made():
    r = random.Random(4)
    bits = ["a@b.c", "a@b.c@d.e", "x@y.z_k@w.v", "bob.s+1@mail.example.com.", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111  1111 1111", "4111111111111112", "+1 (555) 010-9999", "+1 2", "+49 30 1234567 ", "+1.555.010.9999 + 3", "42", "é@x.y", "(tel:", "Phone", "fax,", "Mr. Kowalski", "naïve", "\n", "\t", "😀", "...", "@", "+", "1.1.1", "7 7 7", "4111111111111111@card.org"]
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)]
    text = lambda n: r.choice((" ", " ", "")).join(r.choice(bits) if r.random() < 0.4 else " " + r.choice(words) + " " for _ in range(n))
    rows = [text(r.randint(0, 40)) for _ in range(300)]
    rows += [f"{r.choice(words)} Call Jane Roe at jane.roe@corp.example, {r.choice(words)}" for _ in range(12)] + ["Call Jane Roe soon"]
    rows += [None, "", " ", "1" * 5000, "1 " * 20_000, "a." * 20_000, "a@" + "b." * 20_000 + "c", "+" * 3000, "+1" + "(" * 30_000, "x" * 200_000, "p@q.rs " * 3000, "1.2.3.4 " * 2000]
    return [*enumerate(rows), (3, rows[3]), (None, rows[5]), (None, rows[305])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in made()], "doc_id long, text string, spans string, key int")


def test_matches_and_disclosing_terms(spark, docs):
    want = plain(made())
    assert collected(pii.digest(docs)) == want
    assert any("term" in r[-1] for r in want)


def test_documents_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert collected(pii.digest(table)) == plain([(r.doc_id, r.text) for r in table.collect()])


def test_sanitised(spark, docs):
    got = {r.doc_id: r for r in pii.sanitised(docs).where("doc_id >= 300").collect()}
    assert got[300].text.split(" ", 1)[1].startswith("   at [email], ") and got[300].spans == "clash"
    assert got[312].text == "Call Jane Roe soon" and got[313].text is None


def test_empty(spark, docs):
    assert pii.digest(docs.where("false")).collect() == []
