"""Conversation structure repair: the cheapest edits by lazy weighted determinisation.

The grammar (s?(ua)+)? is a machine of four states: nothing, s, ends with u, ends with a. A row
moves it by an edit that has a cost. The states of the determinised machine are vectors of the
costs with which each of the four can be reached, less their minimum, beside the order of their
ASCII-least edits; they are made when a row first needs them and kept in a table. A scan of a
conversation's rows through that table gives its cost, and a trace back over the arcs that the
vectors were made of, which are tight, gives the edits. Entries that another state beats whatever
follows are left out of a vector, so the vectors are finitely many.

Rows are dealt out by ranges of (conv_id, turn, role, text), so a conversation that holds a third of
all rows lies in many parts. A piece at a part's edge is scanned from every state; the pieces of a
conversation are then joined, a summary for some MB of rows each, and traced from the states found.

Results for odd rows: null roles and texts count as one space; rows with a null conv_id are one
conversation; rows with a null turn come first; rows of one turn are taken by role, then text; a role
whose first letter isn't s, u or a fits only once it is re-roled; equal rows count as often as they
stand there; texts of any length are one row; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
PART_BYTES = 16 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a u, an a or an s, from each state; None: not allowed.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: Where a state's lead over another is worth no more: (state, other, cost).
BEATEN = ((NOTHING, ASSISTANT, 2), (NOTHING, USER, 7), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, 5), (USER, ASSISTANT, 5), (USER, NOTHING, 5), (USER, SYSTEM, 5), (ASSISTANT, USER, 5))
#: A row that must go, then each initial's row, whole and truncated.
GONE, SYMBOLS = 0, 9
INITIALS = "sua "


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * max(0, INITIALS.find(initial) if initial else 3) + truncated if initial in ("s", "u", "a") else 7 + truncated


def inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


class Machine:
    """The determinised machine. States are numbered in the order in which they are made; 0 is the
    start. A state: (cost or None, place of its edits among the others') of each of the four."""

    def __init__(self):
        start = ((0, 0), None, None, None)
        self.states, self.number = [start], {start: 0}
        self.table: dict[tuple[int, int], tuple[int, int, tuple]] = {}

    def step(self, state: int, sym: int) -> tuple[int, int, tuple]:
        """(next state, added cost, arcs): arcs[q] is (state before, edits) of the tight arc into q."""
        if (state, sym) not in self.table:
            self.table[state, sym] = self.made(self.states[state], sym)
        return self.table[state, sym]

    def made(self, vector: tuple, sym: int) -> tuple[int, int, tuple]:
        best: list = [None] * 4
        for q, entry in enumerate(vector):
            if entry is None:
                continue
            cost, place = entry
            at, prefix = q, ""
            for _ in range(3):
                arcs = [(at, DELETE, "D")]
                if sym != GONE:
                    initial, late = INITIALS[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)
                    arcs += [(AFTER[initial][at], late, "K")] if initial != " " else []
                    arcs += [(AFTER[x][at], REROLE + late, "R") for x in "ua"]
                for to, more, edit in arcs:
                    new = (cost + more, place, prefix + edit, q)
                    if to is not None and (best[to] is None or new < best[to]):
                        best[to] = new
                cost, prefix, at = cost + INSERT, prefix + "I", inserted(at)
        best = [None if b is None or any(q == x and best[y] is not None and b[0] > best[y][0] + lead for x, y, lead in BEATEN) else b for q, b in enumerate(best)]
        low = min(b[0] for b in best if b)
        places = {q: k for k, (_, q) in enumerate(sorted((b[1:3], q) for q, b in enumerate(best) if b))}
        state = tuple(None if b is None else (b[0] - low, places[q]) for q, b in enumerate(best))
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state], low, tuple(None if b is None else (b[3], b[2]) for b in best)

    def finish(self, state: int) -> tuple[int, int, str]:
        """(added cost, which of the four, last edits) of the best end."""
        ends = ((NOTHING, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II"))
        cost, _, tail, q = min((v[q][0] + INSERT * len(tail), v[q][1], tail, q) for v in [self.states[state]] for q, tail in ends if v[q])
        return cost, q, tail

    def scan(self, state: int, runs) -> tuple[int, int, list[tuple[int, int, int]]]:
        """(state, cost, steps) after runs of (symbol, times); a step is (state, symbol, times)."""
        cost, steps = 0, []
        for sym, times in runs:
            while times:
                to, more, _ = self.step(state, sym)
                n = times if to == state else 1
                steps.append((state, sym, n))
                state, cost, times = to, cost + more * n, times - n
        return state, cost, steps

    def trace(self, steps, q: int) -> tuple[int, list[str]]:
        """The state of the four before the steps that end in q, and each step's edits."""
        out = []
        for state, sym, times in reversed(steps):
            arcs, edits = self.table[state, sym][2], ""
            while times:
                before, edit = arcs[q]
                n = times if before == q else 1
                edits, q, times = edit * n + edits, before, times - n
            out.append(edits)
        return q, out[::-1]

    def all(self) -> int:
        """Makes every state, on a new machine always in the same order; gives their number."""
        k = 0
        while k < len(self.states):
            for sym in range(SYMBOLS):
                self.step(k, sym)
            k += 1
        return k

    def maps(self, runs) -> tuple[list[int], list[int], list[int]]:
        """Of the complete machine, from each state: the state after the runs, the cost, and the state of the four before them
        for each of the four after them (-1: none)."""
        n = len(self.states)
        to = np.array([[self.step(k, s)[0] for s in range(SYMBOLS)] for k in range(n)])
        more = np.array([[self.step(k, s)[1] for s in range(SYMBOLS)] for k in range(n)])
        arcs = np.array([[[-1 if a is None else a[0] for a in self.step(k, s)[2]] for s in range(SYMBOLS)] for k in range(n)])
        state, cost = np.arange(n), np.zeros(n, np.int64)
        origin = np.array([[-1 if v is None else q for q, v in enumerate(self.states[k])] for k in range(n)])
        for sym, times in runs:
            while times:
                after, arc = to[state, sym], arcs[state, sym]
                new = np.where(arc < 0, -1, np.take_along_axis(origin, np.maximum(arc, 0), 1))
                same = (after == state).all() and (new == origin).all()
                count = times if same else 1
                cost += more[state, sym] * count
                state, origin, times = after, new, times - count
        return state.tolist(), cost.tolist(), origin.reshape(-1).tolist()


@lru_cache(2)
def machine(complete: bool = False) -> Machine:
    """This worker's machine. States that tasks tell each other are those of the complete one, whose
    numbers are the same in every worker."""
    out = Machine()
    if complete:
        out.all()
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows as crc32 of `conv_id:turn` modulo 20 damages
    them; a dropped row has no copies, and is kept to name its conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("fate"))
    fate = lambda k: F.col("fate") == k
    text = F.when(fate(0) | fate(1), "").when(fate(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate(0), "").when(fate(4), "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate(0), 0).when(fate(3), 2).otherwise(1).cast("long").alias("copies"))


class Piece:
    """A conversation's rows of one part: a row's copies and symbol, in order."""

    def __init__(self, rows: list[dict], repeated: set):
        self.rows = [r for r in rows if r["copies"]]
        self.pos = rows[0]["pos"]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.runs: list[list[tuple[int, int]]] = []
        before = None
        for r in self.rows:
            n, initial = r["copies"], r["role"][:1]
            twin = r["pos"] in repeated
            if r["blank"]:
                self.blank += n
                self.runs.append([(GONE, n)])
            else:
                self.duplicate += n if twin else n - 1
                self.truncated += r["truncated"] and not twin
                self.runs.append([(GONE, n)] if twin else [(symbol(initial, r["truncated"]), 1), (GONE, n - 1)][: 1 + (n > 1)])
            self.illegal += (before is not None and before + initial not in ("su", "ua", "au")) + (n - 1)
            before = initial
        self.first = self.rows[0]["role"][:1] if self.rows else None
        self.last = before
        turns = [r["turn"] for r in self.rows if r["turn"] is not None]
        self.low, self.high = (turns[0], turns[-1]) if turns else (None, None)
        self.turns = sum(a != b for a, b in zip(turns, [None, *turns], strict=False))

    def flat(self):
        return (run for runs in self.runs for run in runs)


def pieces(rows: list[dict], repeated: set) -> list[tuple[object, Piece]]:
    """The pieces of a part's rows, in order, each with its conv_id."""
    rows.sort(key=lambda r: r["pos"])
    edge = [k for k, r in enumerate(rows) if not k or r["conv_id"] != rows[k - 1]["conv_id"]]
    return [(rows[a]["conv_id"], Piece(rows[a:b], repeated)) for a, b in zip(edge, [*edge[1:], len(rows)], strict=True)]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
SUMMARY = "part int, pos long, edge boolean, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, ends array<int>, costs array<long>, origins array<int>"
JOINED = f"part int, pos long, entry int, leave int, {REPORT}"
EDITS = "pos long, turn long, edits string, lines array<struct<role:string,text:string>>"


def table_of(rows: list[dict], like: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=like)


def arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def joined(rows: list[dict]) -> list[dict]:
    """The report of a conversation and the states at which each of its pieces begins and ends, from
    the pieces' summaries."""
    rows.sort(key=lambda r: r["part"])
    m = machine(complete=True)
    state, cost, entries = 0, 0, []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    low = high = last = None
    turns = 0
    for r in rows:
        entries.append(state)
        cost += r["costs"][state]
        state = r["ends"][state]
        for k in total:
            total[k] += r[k]
        if r["first"] is not None:
            total["illegal"] += last is not None and last + r["first"] not in ("su", "ua", "au")
            last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
    more, q, _ = m.finish(state)
    out = []
    for k in range(len(rows) - 1, -1, -1):
        r = rows[k]
        out.append({"part": r["part"], "pos": r["pos"], "entry": entries[k], "leave": -1 if k == len(rows) - 1 else q, **dict.fromkeys(("gaps", *total, "cost"))})
        q = r["origins"][4 * entries[k] + q]
    out[-1] |= {**total, "gaps": 0 if low is None else high - low + 1 - turns, "cost": cost + more}
    for r in out:
        r["conv_id"] = rows[0]["conv_id"]
    return out


def applied(conv_id, piece: Piece, ends: tuple[int, int] | None) -> list[dict]:
    """The edits of each row of a piece, and what comes of the row. ends: where the piece begins and
    ends, if that was found beforehand."""
    m = machine(complete=ends is not None)
    entry, q = ends or (0, -1)
    state, _, steps = m.scan(entry, piece.flat())
    tail = ""
    if q < 0:
        _, q, tail = m.finish(state)
    now, edits = m.trace(steps, q)
    # Steps go by runs; a row may have two, and a run several steps.
    out, k = [], 0
    for row, runs in zip(piece.rows, piece.runs, strict=True):
        left, got = sum(n for _, n in runs), ""
        while left:
            got, left, k = got + edits[k], left - steps[k][2], k + 1
        out.append({"conv_id": conv_id, "pos": row["pos"], "turn": row["turn"], "edits": got, "row": row})
    if out:
        out[-1]["edits"] += tail
    for r in out:
        row, lines = r.pop("row"), []
        for edit in r["edits"].replace("D", ""):
            if edit == "K":
                now = AFTER[row["role"][:1]][now]
                lines.append({"role": row["role"], "text": row["text"]})
            else:
                now = inserted(now)
                lines.append({"role": "assistant" if now == ASSISTANT else "user", "text": row["text"] if edit == "R" else ""})
        r["lines"] = lines
    return out


def repair(rows: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables for rows(conv_id, turn, role, text and, if given, copies).

    report: conv_id, gaps, blank, duplicate, truncated, illegal and cost of every conversation.
    edits: conv_id, pos, turn, edits and lines of every distinct row, pos in the order of a
    conversation; edits are its copies' K, R and D and the I before them, lines what it becomes."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    kind = dict(rows.dtypes)["conv_id"]
    head = f"conv_id {kind}, "
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), copies.cast("long").alias("copies"))
    rows = scratch.put(rows.groupBy(*keys).agg(F.sum("copies").alias("copies")), "distinct")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).collect()[0][0] or 0
    rows = rows.repartitionByRange(max(1, -(-size // part_bytes)), *keys).sortWithinPartitions(*keys)
    rows = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), *keys, "copies")
    last = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("blank", last == "").withColumn("truncated", ~F.right(last, F.lit(1)).isin(".", "!", "?"))
    rows = scratch.put(rows, "rows")
    scratch.drop("distinct")

    whole = rows.where("copies > 0 and not blank").select("conv_id", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "part", "pos")
    many = whole.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    many = many.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    twins = whole.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))).where("pos > first").select("part", "pos")
    twins = scratch.put(twins, "twins")

    summary, edit, fold = arrow(spark, head + SUMMARY), arrow(spark, head + EDITS), arrow(spark, head + JOINED)

    def scan(here: pa.Table, there: pa.Table) -> pa.Table:
        release()
        if not here.num_rows:
            return summary.empty_table()
        part, m, out = here["part"][0].as_py(), machine(), []
        found = pieces(here.to_pylist(), set(there["pos"].to_pylist()))
        for k, (conv_id, p) in enumerate(found):
            row = {n: getattr(p, n) for n in ("pos", "low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal")}
            row |= {"conv_id": conv_id, "part": part, "edge": k in (0, len(found) - 1)}
            if row["edge"]:
                row["ends"], row["costs"], row["origins"] = machine(complete=True).maps(p.flat())
            else:
                state, cost, _ = m.scan(0, p.flat())
                row["cost"] = cost + m.finish(state)[0]
            out.append(row)
        return table_of(out, summary)

    def fold_edges(table: pa.Table) -> pa.Table:
        return table_of(joined(table.to_pylist()), fold)

    def edited(here: pa.Table, there: pa.Table) -> pa.Table:
        release()
        notes = {r["pos"]: (r["entry"], r["leave"]) for r in there.to_pylist() if r["entry"] is not None}
        repeated = {r["pos"] for r in there.to_pylist() if r["entry"] is None}
        out = []
        for conv_id, p in pieces(here.to_pylist(), repeated):
            out += applied(conv_id, p, notes.get(p.pos))
        return table_of(out, edit)

    light = rows.drop("text")
    found = scratch.put(light.groupBy("part").cogroup(twins.groupBy("part")).applyInArrow(scan, head + SUMMARY), "pieces")
    edges = scratch.put(found.where("edge").groupBy("conv_id").applyInArrow(fold_edges, head + JOINED), "edges")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = found.where("not edge").select("conv_id", gaps, *columns[2:]).union(edges.where("cost is not null").select(*columns))
    notes = edges.select("part", "pos", "entry", "leave").union(twins.select("part", "pos", F.lit(None).cast("int"), F.lit(None).cast("int")))
    edits = scratch.put(rows.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(edited, head + EDITS), "edits")
    return report, edits


def digest(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The report of the damaged rows, with `audit`, all edits of a conversation in order, and
    `repaired_sha256` of its lines. Both are read from the edits as a sorted stream: SHA-256 has no
    parallel form, so a conversation's lines pass through one task, a batch at a time."""
    report, edits = repair(damage(conversations), part_bytes)
    head = f"conv_id {dict(edits.dtypes)['conv_id']}, audit string, repaired_sha256 string"
    like = arrow(edits.sparkSession, head)

    def hashed(batches):
        release()
        now, got, audit, sha, lines = None, False, [], hashlib.sha256(), 0
        end = lambda: {"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not got or r["conv_id"] != now:
                    if got:
                        out.append(end())
                    now, got, audit, sha, lines = r["conv_id"], True, [], hashlib.sha256(), 0
                audit.append(r["edits"])
                for x in r["lines"]:
                    sha.update((("\n" if lines else "") + x["role"] + ":" + x["text"]).encode())
                    lines += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=like)
        if got:
            yield pa.RecordBatch.from_pylist([end()], schema=like)

    made = edits.select("conv_id", "pos", "edits", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos").mapInArrow(hashed, head)
    made = made.withColumnRenamed("conv_id", "c")
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = report.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return out.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))
