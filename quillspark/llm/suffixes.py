"""Suffix dedup: bytes covered by a string of `length` bytes that an earlier document holds.

The suffixes are sorted to that depth, blockwise, with a difference cover:

1. The cover {0, 1, 4, 14, 16} modulo 21 holds, for any two places of texts, an offset below 21
   that leads from both to sampled places. So two suffixes that agree in `length` bytes have, at one
   and the same offset, sampled suffixes that agree in length - 20. Only sampled places, 5 of 21,
   are sorted corpus-wide. Fingerprints tell first which of them can have an equal in another
   document; that they agree by chance only adds work.
2. These go to buckets, an equal's with its equal's, with the 20 bytes on either side, a share of the
   buckets after another. One bucket at a time is sorted in a task of bounded memory: the sampled
   strings by their leading bytes, eight at a time, among ties alone, which gives each its exact
   rank. Of the suffixes that start `offset` bytes before a sampled place, those with equal bytes in
   front tie, and the sample's rank resolves the tie; what the rank doesn't reach, 20 - offset bytes
   at the end, is compared too. The smallest document of each class of suffixes answers.
3. Each block of texts marks the bytes that suffixes with a smaller document cover.

Bytes decide throughout, so results are exact whatever the fingerprints are.

Results for odd rows: a null text is empty; texts under `length` bytes lose nothing; texts of any
length are one row of one block; rows with equal ids don't count against each other; a null id is
greater than all others; an empty table gives no rows; columns other than doc_id and text are not
read, whatever their names. Matches never cross documents.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Answers, Blocks, Texts, answer, first_key, packed, repeated
from .common import Scratch
from .hashing import BASE, TABLE, covered, mix, powers

LENGTH, PERIOD, COVER = 50, 21, (0, 1, 4, 14, 16)
AROUND = PERIOD - 1
#: Bytes of a sampled string's fingerprint.
SHORT = 6
#: Shares of the buckets that are sorted one after another.
ROUNDS = 2


def ranked(columns: list[np.ndarray], order: np.ndarray | None = None, new: np.ndarray | None = None):
    """(order, new): rows in ascending order of the columns, equal ones in their own order, and where
    in it a row differs from the one before. Each column sorts the ties of those before it alone,
    and of these only such as it parts. order and new: a sort by earlier columns to go on from."""
    n = len(columns[0])
    if order is None:
        order = np.argsort(columns[0], kind="stable")
        first = columns[0][order]
        new = np.concatenate(([True], first[1:] != first[:-1])) if n else np.empty(0, bool)
        columns = columns[1:]
    order, new = order.copy(), new.copy()
    for c in columns:
        at = c[order]
        parts = np.flatnonzero((at[1:] != at[:-1]) & ~new[1:])
        if not len(parts):
            continue
        group = np.cumsum(new) - 1
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[parts]] = True
        some = np.flatnonzero(mixed[group])
        rows, of, value = order[some], group[some], at[some]
        by = np.lexsort((value, of))
        order[some], value = rows[by], value[by]
        new[some[1:]] |= (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return order, new


def columns_of(data: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, so that words compare as the bytes do."""
    width = -(-data.shape[1] // 8) * 8
    full = np.zeros((len(data), width), np.uint8)
    full[:, : data.shape[1]] = data
    return list(np.ascontiguousarray(full.view(">u8").astype(np.uint64).T))


class Places:
    """Byte places of a block's texts, one text after another."""

    def __init__(self, block: Texts, length: int):
        sizes = np.array([len(t) for t in block.texts], np.int64)
        self.length, self.numbers = length, block.numbers
        self.limits = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(b"".join(block.texts), np.uint8)
        self.n, self.owner = len(self.data), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        phase = np.zeros(PERIOD, bool)
        phase[list(COVER)] = True
        #: Sampled places, counted from each text's start, with a whole string after them.
        at = np.flatnonzero(phase[(np.arange(self.n) - self.limits[self.owner]) % PERIOD])
        self.at = at[at + length - AROUND <= self.limits[self.owner[at] + 1]]
        self.keys = self.fingerprints() & np.uint64(2**64 - 2 ** (64 - 8 * SHORT))

    def fingerprints(self) -> np.ndarray:
        up, down = powers(BASE, max(1, self.n))
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(TABLE[self.data] * up[: self.n], out=sums[1:])
        return mix((sums[self.at + self.length - AROUND] - sums[self.at]) * down[self.at])

    def documents(self, at: np.ndarray) -> np.ndarray:
        return self.numbers[self.owner[at]]

    def contexts(self, found: Answers, low: int = 0, high: int = 2**64 - 1):
        """Of the sampled places that can have an equal, with fingerprints from low to high: the places
        by fingerprint and context, where a new context starts, the fingerprints, the contexts (the
        bytes before, the string, the bytes after, zero beyond the text, and the numbers of bytes
        before and after), and the places' documents."""
        distinct, inverse = np.unique(self.keys, return_inverse=True)
        some = np.flatnonzero(found.bits(distinct)[inverse] & (self.keys >= np.uint64(low)) & (self.keys <= np.uint64(high)))
        at, keys, width = self.at[some], self.keys[some], self.length + AROUND
        text = self.owner[at]
        before = np.minimum(AROUND, at - self.limits[text])
        after = np.minimum(AROUND, self.limits[text + 1] - at - self.length + AROUND)
        padded = np.concatenate((np.zeros(AROUND, np.uint8), self.data, np.zeros(AROUND, np.uint8)))
        rows = np.empty((len(at), width + 2), np.uint8)
        rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[at] if len(at) else 0
        k = np.arange(AROUND)
        rows[:, :AROUND] *= k >= AROUND - before[:, None]
        rows[:, self.length : width] *= k < after[:, None]
        rows[:, width], rows[:, width + 1] = before, after
        order, new = ranked([keys, *columns_of(rows)])
        return at[order], new, keys[order], rows[order], self.documents(at[order])


    def covered_by(self, bits: bytes | None, at, new, keys, rows, docs) -> np.ndarray:
        """Bytes covered by suffixes that a smaller document holds. bits: `smaller`'s answers for the
        contexts, in their order."""
        if bits is None or not len(at) or self.n < self.length:
            bits = bytes(3 * int(new.sum()))
        three = np.zeros((len(bits) // 3, 4), np.uint8)
        three[:, :3] = np.frombuffer(bits, np.uint8).reshape(-1, 3)
        of = np.cumsum(new) - 1
        own = three.view("<u4")[:, 0][of]
        flags = np.zeros(max(0, self.n - self.length + 1), bool)
        before, after = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        # What the block's first document with a context holds, its later ones have from that one.
        later = docs > docs[new][of] if len(of) else np.empty(0, bool)
        for d in range(PERIOD):
            hit = ((own >> np.uint32(d)) & 1).astype(bool) | (later & (d <= before) & (AROUND - d <= after))
            flags[at[hit] - d] = True
        return covered(flags, self.length, self.n) if len(flags) else np.zeros(self.n, bool)


def with_documents(rows: np.ndarray, docs: np.ndarray) -> bytes:
    """A slice: contexts and their documents, compressed, documents as differences from the least."""
    least = int(docs.min())
    low = (docs.view(np.uint64) - np.uint64(least % 2**64)).astype("<u8")
    data = rows.tobytes() + low.tobytes()
    return struct.pack("<qq", least, len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def opened(payload: bytes, n: int, width: int):
    least, size = struct.unpack_from("<qq", payload)
    data = pa.decompress(memoryview(payload)[16:], size, codec="zstd", asbytes=True)
    docs = (np.frombuffer(data, "<u8", n, n * width) + np.uint64(least % 2**64)).view(np.int64)
    return np.frombuffer(data, np.uint8, n * width).reshape(n, width), docs


def smaller(payloads: list[bytes], sizes: list[int], length: int) -> list[bytes | None]:
    """A bucket's sort. For each slice three bytes a context: the offsets, as bits, of the suffixes
    around it that a smaller document holds."""
    width = length + AROUND
    parts = [opened(p, n, width + 2) for p, n in zip(payloads, sizes, strict=True)]
    rows, docs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order, new = ranked(columns_of(rows[:, AROUND:length]))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(new) - 1
    sides = np.concatenate((rows[:, :AROUND], rows[:, length:]), 1)
    order, new = ranked(columns_of(sides), order, new)
    context = np.empty(len(rows), np.int64)
    context[order] = np.cumsum(new) - 1
    edge = np.flatnonzero(new)
    # Of each distinct context: its smallest document, its row, and the rank of its string.
    least, one = np.minimum.reduceat(docs[order], edge), order[edge]
    before, after = rows[one, width].astype(np.int64), rows[one, width + 1].astype(np.int64)
    offsets = np.arange(PERIOD)
    valid = (offsets <= before[:, None]) & (AROUND - offsets <= after[:, None])
    of = rank[one]
    several = np.flatnonzero(np.bincount(of)[of] > 1)
    # A string with one context has the same suffixes everywhere; else they are told apart.
    low = np.where(valid, least[:, None], 2**63 - 1)
    beside, group = sides[one[several]][:, : 2 * AROUND], of[several].astype(np.uint64)
    for d in range(PERIOD):
        here = np.flatnonzero(valid[several, d])
        if len(here):
            order, new = ranked([group[here], *columns_of(beside[here, AROUND - d : 2 * AROUND - d])])
            edge, values = np.flatnonzero(new), least[several[here]][order]
            smallest = np.minimum.reduceat(values, edge)
            low[several[here[order]], d] = smallest[np.cumsum(new) - 1]
    bits = ((low[context] < docs[:, None]) @ (1 << offsets)).astype("<u4")
    out = bits.view(np.uint8).reshape(-1, 4)[:, :3]
    at = np.cumsum([0, *sizes])
    return [out[a:b].tobytes() if bits[a:b].any() else None for a, b in zip(at[:-1], at[1:], strict=True)]


def remove_earlier(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ('from-to' bytes, comma-joined) and the kept bytes
    for each row of docs(doc_id, text)."""
    if length < 2 * PERIOD - 2:
        raise ValueError(f"length must be {2 * PERIOD - 2} at least")
    scratch, blocks = Scratch(docs.sparkSession, "suffixes"), Blocks(docs)

    def sample(block: Texts):
        p = Places(block, length)
        order = np.argsort(p.keys, kind="stable")
        keys, owners = p.keys[order], p.documents(p.at[order])
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        # Places ascend in a class, and so do documents.
        several = owners[edge] != owners[np.append(edge[1:], len(keys)) - 1] if len(edge) else np.empty(0, bool)
        distinct = keys[edge]
        return distinct, lambda a, b: packed(distinct[a:b], SHORT) + np.packbits(several[a:b]).tobytes()

    def sender(low: int, high: int):
        """Sends the contexts with fingerprints from low to high."""

        def send(block: Texts, found: Answers):
            _, new, keys, rows, docs_ = Places(block, length).contexts(found, low, high)
            return keys[new], lambda a, b, rows=rows[new], docs_=docs_[new]: with_documents(rows[a:b], docs_[a:b])

        return send

    def finish(block: Texts, both: Answers):
        p = Places(block, length)
        found = p.contexts(both.only(lambda k: k >= 0))
        keys = found[2][found[1]]
        bits = np.zeros((len(keys), 3), np.uint8)
        for a, b, payload in both.only(lambda k: k < 0, lambda k: -1 - k).slices(keys):
            bits[a:b] = np.frombuffer(payload, np.uint8).reshape(-1, 3)
        gone = p.covered_by(bits.tobytes(), *found)
        n_removed, n_spans, runs, kept = [], [], [], []
        for text, a, b in zip(block.texts, p.limits[:-1], p.limits[1:], strict=True):
            cut = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0])))).reshape(-1, 2)
            n_removed.append(int(cut.sum()))
            n_spans.append(len(edge))
            runs.append(",".join(f"{x}-{y}" for x, y in edge))
            kept.append(np.frombuffer(text, np.uint8)[~cut].tobytes() if len(edge) else text)
        return {"doc_id": block.ids, "n_bytes": np.diff(p.limits), "n_removed": n_removed, "n_spans": n_spans, "spans": runs, "kept": kept}

    classes = scratch.put(answer(blocks.send(sample), lambda p, n: repeated(p, n, SHORT)), "classes")
    # A share of the buckets at a time, so that no more of the contexts lie on disks at once.
    lows = None
    for k in range(ROUNDS):
        low, high = first_key(k * blocks.n // ROUNDS, blocks.n), first_key((k + 1) * blocks.n // ROUNDS, blocks.n) - 1
        got = scratch.put(answer(blocks.send_with(classes, sender(low, high)), lambda p, n: smaller(p, n, length)), f"lows{k}")
        lows = got if lows is None else lows.union(got)
    both = classes.union(lows.withColumn("bucket", -1 - F.col("bucket")))
    return blocks.finish(both, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove_earlier(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
