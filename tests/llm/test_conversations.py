import heapq
import random
import re
import zlib
from collections import defaultdict

import brute
import pytest

from quillspark.llm import conversations

GRAMMAR = re.compile("(s?(ua)+)?")
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, copies string, pos int"


def damaged(rows):
    some = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{some(c)}:{some(t)}".encode()) % 20
        role, text = some(role), some(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(c, t, "user" if fate == 4 else role, text)] * (1 + (fate == 3))


def cheapest(rows):
    """(cost, audit, lines) by uniform-cost search over every sequence of edits; rows: (role, text, fault)."""
    after = lambda out, x: out + x if re.fullmatch("s?(ua)*u?", out + x) else None
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, out, lines = heapq.heappop(heap)
        if k > len(rows):
            return cost, audit, lines
        short = re.sub("(ua)+", "ua", out)
        if (cost, audit, k, short) in seen:
            continue
        seen.add((cost, audit, k, short))
        arcs = [(5, "I", k, after(short, x), (*lines, f"{r}:")) for r, x in (("user", "u"), ("assistant", "a")) if not audit.endswith("II")]
        if k < len(rows):
            role, text, fault = rows[k]
            arcs.append((2, "D", k + 1, short, lines))
            if fault in (None, "truncated"):
                late = 5 * (fault == "truncated")
                arcs.append((late, "K", k + 1, after(short, role[:1]) if role[:1] else None, (*lines, f"{role}:{text}")))
                arcs += [(1 + late, "R", k + 1, after(short, r[0]), (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        elif GRAMMAR.fullmatch(short):
            arcs.append((0, "", k + 1, short, lines))
        for more, edit, to, now, then in arcs:
            if now is not None:
                heapq.heappush(heap, (cost + more, audit + edit, to, now, then))


def plain(table):
    found = defaultdict(list)
    for r in table:
        found[r[0]] += []
    for r in damaged(table):
        found[r[0]].append(r)
    out = []
    for c, rows in found.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked, n = set(), [], defaultdict(int)
        for _, _, role, text in rows:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns = {r[1] for r in rows} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, brute.sha("\n".join(lines).encode())))
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "  ", "", "Why?", "é \t", "Fine. \n", "one", "Two?"]
    rows = []
    for c in [*range(n), None]:
        k = 0
        for i in range(r.choice((1, 2, 5, 9))):
            k += r.choice((1, 1, 1, 1, 0, 2))
            role = r.choice(("system", "user", "assistant")) if r.random() < 0.4 else ("user", "assistant")[i % 2]
            role = r.choice((role,) * 12 + ("tool", None, "", "User"))
            text = r.choice(texts) if r.random() < 0.5 else f"Text {r.randrange(1000)}" + r.choice((".", "!", ""))
            rows.append((c, None if r.random() < 0.05 else k, role, None if r.random() < 0.05 else text))
            rows += rows[-1:] * (r.random() < 0.06)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_cheapest_edits(spark, part_bytes):
    """With parts of a few rows, conversations lie in several."""
    rows = made(5, 120)
    assert collected(conversations.digest(frame(spark, rows).drop("copies"), part_bytes)) == plain(rows)


def test_one_conversation_in_many_parts(spark):
    r = random.Random(2)
    rows = [(1, t, ("user", "assistant")[t % 2], r.choice(("Yes.", f"Text {t}.", f"Text {t}", f"Then {t}!"))) for t in range(60)] + [(0, 0, "user", "Yes."), (2, 5, "user", "No.")]
    got = [collected(conversations.digest(frame(spark, rows).drop("copies"), b)) for b in (1 << 20, 200)]
    assert got[0] == got[1]


def test_documents_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert collected(conversations.digest(table)) == plain(rows)


def test_empty_and_dropped(spark):
    assert collected(conversations.digest(frame(spark, []).drop("copies"))) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    rows = [(3, gone, "user", "Hi.")]
    assert collected(conversations.digest(frame(spark, rows).drop("copies"))) == [(3, 0, 0, 0, 0, 0, 0, "", brute.sha(b""))]


def test_very_long_text_and_runs_of_equal_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * 3_000_000 + ".") for t in range(4)]
    assert collected(conversations.digest(frame(spark, rows).drop("copies"))) == plain(rows)
    rows = [(2, 1, "user", "Same.", 500), (2, 2, "assistant", "End.", 1)]
    report, edits = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long"))
    assert [tuple(r) for r in report.collect()] == [(2, 0, 0, 499, 0, 499, 998)]
    assert [r.edits for r in edits.sort("pos").collect()] == ["K" + "D" * 499, "K"]


def test_states_are_finitely_many_and_numbered_alike():
    """Whatever a worker's tasks have scanned before, states that tasks exchange have the same numbers."""
    lazy = conversations.machine()
    lazy.scan(0, [(k, 2) for k in range(conversations.SYMBOLS - 1, -1, -1)])
    fresh = conversations.Machine()
    assert fresh.all() < 1000
    assert conversations.machine(complete=True).states == fresh.states != lazy.states
