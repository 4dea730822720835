"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted over the corpus.

Windows that occur twice or more, in one text or in several, merge into maximal removal
intervals. Windows are counted by 64 bits first; those that repeat are counted again by 128, so that
of n windows two that differ are taken for one with probability n*n / 2**129.

Results for odd rows: null and empty texts have no words and nothing to remove; texts shorter than
a window are kept; texts of any length are one row of one block; a repeated row repeats all its
windows, so both copies lose them; an empty table gives no rows; other columns are not read, whatever
their names, but for those named in carry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Answers, Blocks, Texts, answer, packed, repeated
from .common import Scratch
from .hashing import SECOND, TABLE, covered, inside, spans, window_hashes, word_hashes

WIDTH = 35


class Windows:
    """The windows of a block's texts. hashes: of each; at: the words at which they start; owner: each
    word's text; starts and ends: each word's bytes in the joined texts."""

    def __init__(self, block: Texts, width: int):
        self.data = np.frombuffer(b"\n".join(block.texts), np.uint8)
        self.starts, self.ends = spans(self.data)
        self.limits = np.cumsum([0, *[len(t) + 1 for t in block.texts]])
        self.owner = np.searchsorted(self.limits[1:], self.starts, "right")
        self.at = np.flatnonzero(inside(self.owner, width))
        self.width = width
        self.hashes = self.hashed(TABLE)

    def hashed(self, table: np.ndarray) -> np.ndarray:
        return window_hashes(word_hashes(self.data, self.starts, self.ends, table), self.width)[self.at]

    def repeated(self, found: Answers):
        """Those windows whose hash repeats, their distinct pairs of hashes, and each one's pair."""
        keys, inverse = np.unique(self.hashes, return_inverse=True)
        some = np.flatnonzero(found.bits(keys)[inverse])
        first, second = self.hashes[some], self.hashed(SECOND)[some] if len(some) else np.empty(0, np.uint64)
        order = np.lexsort((second, first))
        pairs = np.stack((first, second), 1)[order]
        new = np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1))) if len(some) else np.empty(0, bool)
        of = np.empty(len(some), np.int64)
        of[order] = np.cumsum(new) - 1
        return some, pairs[new], of


def twice(payloads: list[bytes], sizes: list[int]) -> list[bytes | None]:
    """`repeated` for slices of pairs of hashes."""
    pairs = np.concatenate([np.frombuffer(p, "<u8", 2 * n).reshape(n, 2) for p, n in zip(payloads, sizes, strict=True)])
    flags = np.concatenate([np.unpackbits(np.frombuffer(p[16 * n :], np.uint8), count=n).astype(bool) for p, n in zip(payloads, sizes, strict=True)])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    same = (pairs[order][1:] == pairs[order][:-1]).all(1)
    twin = np.zeros(len(pairs), bool)
    twin[1:] |= same
    twin[:-1] |= same
    flags[order] |= twin
    at = np.cumsum([0, *sizes])
    return [np.packbits(x).tobytes() if x.any() else None for x in (flags[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]


def without(text: bytes, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> bytes:
    """The text without runs of words [x, y), each with the white space up to the next word, or at the
    text's end with the space before it; all else stays byte for byte."""
    out, at = [], 0
    for x, y in runs.tolist():
        low, high = (starts[x], starts[y]) if y < len(starts) else (ends[x - 1] if x else starts[0], ends[-1])
        out.append(text[at:low])
        at = high
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH, carry: list[str] = (), layout: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans ('from-to' words removed, comma-joined) and the kept text
    for each row of docs(doc_id, text), and the columns named in carry. The kept text is the kept
    words joined by one space, or with layout the text as it was outside what is removed."""
    scratch, blocks = Scratch(docs.sparkSession, "substring"), Blocks(docs, carry)

    def send(block: Texts):
        keys, counts = np.unique(Windows(block, width).hashes, return_counts=True)
        return keys, lambda a, b: packed(keys[a:b], 8) + np.packbits(counts[a:b] > 1).tobytes()

    def send_again(block: Texts, found: Answers):
        _, pairs, of = Windows(block, width).repeated(found)
        several = np.bincount(of, minlength=len(pairs)) > 1
        return pairs[:, 0], lambda a, b: pairs[a:b].astype("<u8").tobytes() + np.packbits(several[a:b]).tobytes()

    def finish(block: Texts, answers: Answers):
        w = Windows(block, width)
        some, pairs, of = w.repeated(answers.only(lambda k: k >= 0))
        flags = np.zeros(max(0, len(w.owner) - width + 1), bool)
        flags[w.at[some]] = answers.only(lambda k: k < 0, lambda k: -1 - k).bits(pairs[:, 0])[of]
        gone = covered(flags, width, len(w.owner)) if len(flags) else np.zeros(len(w.owner), bool)
        limits = np.searchsorted(w.owner, np.arange(len(block.texts) + 1))
        n_removed, kept, runs = [], [], []
        for k, (text, a, b) in enumerate(zip(block.texts, limits[:-1], limits[1:], strict=True)):
            cut = gone[a:b]
            n_removed.append(int(cut.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0])))).reshape(-1, 2)
            runs.append(",".join(f"{x}-{y}" for x, y in edge))
            if layout:
                kept.append((without(text, w.starts[a:b] - w.limits[k], w.ends[a:b] - w.limits[k], edge) if len(edge) else text).decode())
            else:
                ws = text.split()
                kept.append((b" ".join(x for x, c in zip(ws, cut, strict=True) if not c) if len(edge) else b" ".join(ws)).decode())
        return {"doc_id": block.ids, "n_words": np.diff(limits), "n_removed": n_removed, "spans": runs, "kept": kept}

    found = scratch.put(answer(blocks.send(send), repeated), "found")
    again = scratch.put(answer(blocks.send_with(found, send_again), twice), "again")
    both = found.union(again.withColumn("bucket", -1 - F.col("bucket")))
    return blocks.finish(both, finish, "doc_id long, n_words long, n_removed long, spans string, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(width: int = WIDTH) -> str:
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - {width - 1})) AS i FROM t WHERE len(w) >= {width})),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + d AS i FROM hit, (SELECT unnest(generate_series(0, {width - 1})) AS d)),
word AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM t)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""
