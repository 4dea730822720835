"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes if, and only if, each two neighbours are left
unmerged by the merges when they stand alone together. So the encoding of a text's prefix of
length i + 1 is that of a shorter prefix plus one token that ends at i and fits the shorter one's
last token, and exactly one such pair exists. The transducer reads a byte at a time and keeps the
prefixes which a longer token may still continue. Once all of these share their first tokens, it
emits them: the lookahead is bounded by the vocabulary. What is left to keep is the last emitted
token and the bytes after it. This pair is the state; states and transitions are made when an input
first asks for them, and dropped together when the table has grown to its limit. Pieces that leave
the states made so far go on from their own state through the open places, many pieces at a time.

Results for odd rows: null and empty texts have no ids; repeated rows are encoded row by row; texts
of any length are encoded piece by piece, in linear time; an empty table gives no rows; a null doc_id
stays null; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from contextlib import contextmanager
from functools import cached_property
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, small_batches

#: States of a transducer; bytes that a worker's table of encoded pieces, and that of runs, may take.
MOST_STATES, MOST_BYTES = 1 << 16, (16 << 20, 96 << 20)
#: Bytes that run through the open places at most before transitions are made for them, and bytes
#: that do so together.
MOST_REST, MOST_TOGETHER = 256, 1 << 20
#: Requests for a transition until it is made, and the fewest pieces whose rests run together.
REQUESTS, MANY = 32, 64
#: Runs that are looked up together, and the longest of them in characters.
MOST_RUNS, LONGEST_RUN = 1 << 17, 256
#: Bits of the number of answers that are kept on whether two tokens fit.
FIT_BITS = 19
#: Of the pattern's pieces none crosses a space that follows a character other than white space.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def words(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place below 2 ** bits for each of many integers."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


class Lookup:
    """Integers by integers, none negative and keys distinct, for many keys at a time: an open hash
    table. Unknown keys give -1."""

    def __init__(self, known: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(known)) for x in (known.keys(), known.values()))
        self.bits = (4 * len(keys) + 1).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        at = slots(keys, self.bits)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], self.after(at[~here])

    def after(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = slots(keys, self.bits)
        found, out = self.keys.take(at), self.values.take(at)
        other = np.flatnonzero(found != keys)
        out[other] = -1
        other = other[found[other] >= 0]
        at = at[other]
        while len(other):  # the place is another key's
            at = self.after(at)
            found = self.keys[at]
            same = found == keys[other]
            out[other[same]] = self.values[at[same]]
            more = ~same & (found >= 0)
            other, at = other[more], at[more]
        return out


class State:
    """last: the token emitted last, -1 at the start; pending: bytes after it. ends: for each open
    place of pending its node of the token trie and the tokens that lead there, the last place being
    pending's end. moves: what each byte emits and the state after it."""

    __slots__ = ("ends", "last", "moves", "pending")

    def __init__(self, last: int, pending: bytes, ends: tuple):
        self.last, self.pending, self.ends, self.moves = last, pending, ends, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most = ranks, most_states
        size = max(ranks.values()) + 1
        #: Tokens that the merges make of their own bytes, by their two halves; others come out only
        #: as whole pieces. pair: the token of two neighbours, keyed by left * size + right.
        self.left, self.right, self.size = [-1] * size, [-1] * size, size
        self.pair: dict[int, int] = {}
        #: The trie: a node's child by node * 256 + byte; each node's token, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token, self.open = [-1], [True]
        for t, rank in ranks.items():
            parts = self.merged(t, 2) if len(t) > 1 else [t]
            if len(parts) == 2:
                self.left[rank], self.right[rank] = left, right = ranks[parts[0]], ranks[parts[1]]
                self.pair[left * size + right] = rank
            elif len(t) > 1:
                continue
            node = 0
            for byte in t:
                self.open[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
                node = self.child[key]
            self.token[node] = rank
        self.fit: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        for s in getattr(self, "states", {}).values():
            s.moves.clear()  # states refer to one another in circles
        self.states: dict[tuple, State] = {}
        self.start = self.state(-1, b"", ((0, 0, ()),))

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The merges applied in order of rank to a short string, by definition, down to `stop`
        parts; a last step that leads to one part must make the string's own token."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens side by side. They don't if some merge across
        their limit comes before the merge that closes it off: the parts at the limit are taken
        apart in reverse order of rank, and at each step the pair that meets there is looked up."""
        pair, size, a, b, before = self.pair, self.size, left, right, 1 << 60
        while True:
            met = pair.get(a * size + b)
            if met is not None and met < before:
                known = False
                break
            # A token's rank is its id. Single bytes have no halves.
            ra, rb = a if self.left[a] >= 0 else -1, b if self.left[b] >= 0 else -1
            if ra < 0 and rb < 0:
                known = True
                break
            # A merge of equal rank goes to the leftmost place, so the left token's comes first.
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]
        if len(self.fit) >= 4 * self.most:
            self.fit.clear()
        self.fit[left * size + right] = known
        return known

    def state(self, last: int, pending: bytes, ends: tuple) -> State:
        found = self.states.get((last, pending))
        if found is None:
            found = self.states[last, pending] = State(last, pending, ends)
        return found

    def move(self, s: State, byte: int) -> tuple[tuple[int, ...], State]:
        child, token, opens, fit, size, last = self.child, self.token, self.open, self.fit, self.size, s.last
        tokens, ends = None, []
        for k, node, before in s.ends:  # places ascend
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if tokens is None:
                t = token[node]
                if t >= 0:
                    left = before[-1] if before else last
                    if left < 0:
                        tokens = (*before, t)
                    else:
                        fits = fit.get(left * size + t)
                        if fits or (fits is None and self.fits(left, t)):
                            tokens = (*before, t)
            if opens[node]:
                ends.append((k, node, before))
        if tokens is None:
            raise ValueError("the vocabulary lacks a byte")
        pending = s.pending + bytes((byte,))
        common = len(tokens)
        for _, _, path in ends:
            if len(path) < common:
                common = len(path)
            while common and path[:common] != tokens[:common]:
                common -= 1
            if not common:
                break
        if not common:
            made = s.moves[byte] = (), self.state(last, pending, (*ends, (len(pending), 0, tokens)))
            return made
        # Equal tokens up to here start at equal places, so they are the same prefix.
        out, starts = tokens[:common], len(pending)
        if len(tokens) > common or ends:
            starts = sum(self.lengths[t] for t in out)
        after = tuple((k - starts, node, path[common:]) for k, node, path in ends)
        made = s.moves[byte] = out, self.state(out[-1], pending[starts:], (*after, (len(pending) - starts, 0, tokens[common:])))
        return made

    @cached_property
    def lengths(self) -> list[int]:
        out = [0] * self.size
        for t, rank in self.ranks.items():
            out[rank] = len(t)
        return out

    def walk(self, piece: bytes) -> tuple[list[int], State, int]:
        """What the transitions emit for a piece, the state they end in and the place where they end:
        before the piece's own end if the next transition isn't made yet. It is made when it is asked
        for the REQUESTS-th time, or if too much of the piece is left. Where the states reach their
        limit, all but the current one go, in the middle of a piece too."""
        s, out, most = self.start, [], self.most
        for at, byte in enumerate(piece):
            got = s.moves.get(byte, 1)
            if got.__class__ is int:
                if got < REQUESTS:
                    s.moves[byte] = got + 1
                    if len(piece) - at <= MOST_REST:
                        return out, s, at
                if len(self.states) > most:
                    self.clear()
                    s = self.state(s.last, s.pending, s.ends)
                got = self.move(s, byte)
            emitted, s = got
            if emitted:
                out += emitted
        return out, s, len(piece)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; a piece that is a token is that token. Where transitions aren't made yet,
        the rest of the piece runs through the open places as they are."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        out, s, at = self.walk(piece)
        return out + (self.rest(s, piece[at:]) if at < len(piece) else list(s.ends[-1][2]))

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian words. The rests of many pieces run together."""
        if len(pieces) < MANY:
            return [words(self.encode(p)) for p in pieces]
        out, late, last, data, size, known = [], [], [], [], 0, self.ranks
        for piece in pieces:
            if piece in known:
                out.append(words((known[piece],)))
                continue
            ids, s, at = self.walk(piece)
            if at == len(piece):
                ids += s.ends[-1][2]
            else:
                late.append(len(out))
                last.append(s.last)
                data.append(s.pending + piece[at:])
                size += len(data[-1])
            out.append(words(ids))
            if size > MOST_TOGETHER:
                self.finish(out, late, last, data)
                late, last, data, size = [], [], [], 0
        if late:
            self.finish(out, late, last, data)
        return out

    def finish(self, out: list[bytes], late: list[int], last: list[int], data: list[bytes]) -> None:
        ids, ends = self.rests(last, data)
        every, a = ids.astype("<u4").tobytes(), 0
        for k, b in zip(late, (4 * ends).tolist(), strict=True):
            out[k] += every[a:b]
            a = b

    @cached_property
    def tables(self) -> tuple:
        """For many bytes at a time: children, tokens and openness of nodes, halves of tokens and
        tokens of pairs, and answers on which pairs fit."""
        return Lookup(self.child), np.array(self.token), np.array(self.open), np.array(self.left), np.array(self.right), Lookup(self.pair), np.full(1 << FIT_BITS, -1), np.zeros(1 << FIT_BITS, bool)

    def fits_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As `fits`, for many pairs; the latest answer of each place is kept."""
        *_, of_left, of_right, pairs, known, answers = self.tables
        keys = left * self.size + right
        at = slots(keys, FIT_BITS)
        out = answers.take(at)
        new = np.flatnonzero(known.take(at) != keys)
        if not len(new):
            return out
        out[new] = False
        k, a, b, before = new, left[new], right[new], np.full(len(new), 1 << 60)
        while len(k):
            met = pairs.get(a * self.size + b)
            ra, rb = np.where(of_left[a] >= 0, a, -1), np.where(of_left[b] >= 0, b, -1)
            apart = (met < 0) | (met >= before)
            out[k[apart & (ra < 0) & (rb < 0)]] = True
            go = apart & ((ra >= 0) | (rb >= 0))
            k, a, b, ra, rb = k[go], a[go], b[go], ra[go], rb[go]
            by_left = ra > rb
            before = np.where(by_left, ra, rb + 1)
            a, b = np.where(by_left, of_right[a], a), np.where(by_left, b, of_left[b])
        known[at[new]] = keys[new]
        # Of several keys in one place the last is kept, with its own answer.
        kept = known[at[new]] == keys[new]
        answers[at[new[kept]]] = out[new[kept]]
        return out

    def rests(self, last: list[int], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of many strings, given the token before each (-1: none), one after another,
        and where each string's ids end. The steps are those of `rest`, a byte of all strings at a
        time. A prefix that no pair leads to is part of a longer token that began before the
        string, and stays without a place. A prefix of n bytes has the index of the string's byte n."""
        children, token, opens, *_ = self.tables
        every = np.frombuffer(b"\0".join([*data, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        final = np.zeros(len(every), bool)
        final[ends] = True
        by, left = np.full(len(every), -1), np.full(len(every), -1)
        left[starts] = last
        at, start, node = starts, starts, np.zeros(len(data), np.int64)
        while len(at):
            node = children.get(node << 8 | every.take(at))
            go = np.flatnonzero(node >= 0)
            node, at, start = node.take(go), at.take(go) + 1, start.take(go)
            t = token.take(node)
            whole = np.flatnonzero(t >= 0)
            t, end, first = t.take(whole), at.take(whole), start.take(whole)
            before = left.take(first)
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.fits_all(before.take(inner), t.take(inner))
            end = end[fits]
            left[end], by[end] = t[fits], first[fits]
            go = np.flatnonzero(opens.take(node) & ~final.take(at))
            new = end[~final.take(end)]
            at, start = np.concatenate((at.take(go), new)), np.concatenate((start.take(go), new))
            node = np.concatenate((node.take(go), np.zeros(len(new), np.int64)))
        if (by[ends] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        chosen, at = np.zeros(len(every), bool), ends
        while len(at):
            chosen[at] = True
            at = by[at]
            at = at[by[at] >= 0]
        return left[chosen], np.cumsum(np.add.reduceat(chosen, starts, dtype=np.int64))

    def rest(self, s: State, data: bytes) -> list[int]:
        """Ids of what is pending in s and of data after it, without new states: the same steps as
        in `move`, with a place kept as its last token and the place where that token starts."""
        child, token, opens, fit, size = self.child, self.token, self.open, self.fit, self.size
        last = [path[-1] if path else s.last for _, _, path in s.ends]
        start, first, places = [-1] * len(last), len(last), [(node, i) for i, (_, node, _) in enumerate(s.ends)]
        for byte in data:
            found, new = -1, []
            for node, i in places:
                node = child.get(node << 8 | byte)
                if node is None:
                    continue
                if found < 0:
                    t = token[node]
                    if t >= 0:
                        left = last[i]
                        if left < 0:
                            found, by = t, i
                        else:
                            fits = fit.get(left * size + t)
                            if fits or (fits is None and self.fits(left, t)):
                                found, by = t, i
                if opens[node]:
                    new.append((node, i))
            if found < 0:
                raise ValueError("the vocabulary lacks a byte")
            new.append((0, len(last)))
            last.append(found)
            start.append(by)
            places = new
        out, i = [], len(last) - 1
        while i >= first:
            out.append(last[i])
            i = start[i]
        out.reverse()
        return [*s.ends[i][2], *out]


class Table(dict):
    """Encoded strings for reuse; emptied when they take more than `most` bytes, by an estimate that
    counts a Python object's overhead. Long strings are not kept."""

    def __init__(self, make, most: int):
        self.make, self.most, self.size = make, most, 0

    def __missing__(self, text):
        ids = self.make(text)
        self.add(text, ids)
        return ids

    def add(self, text, ids) -> None:
        cost = 200 + 2 * len(text) + len(ids)
        if cost > 4096:
            return
        if self.size + cost > self.most:
            self.empty()
        self.size += cost
        self[text] = ids

    def empty(self) -> None:
        self.clear()
        self.size = 0


class Codec:
    """Texts to ids and back. Ids are kept, as little-endian words, for each piece and, where the
    pattern's pieces can't cross a space, for each run between spaces with the space before it."""

    def __init__(self, path: str, pattern: str, most_bytes: tuple[int, int] = MOST_BYTES):
        import regex

        self.machine = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.pieces = Table(self.piece, most_bytes[0])
        self.runs = Table(self.run, most_bytes[1]) if pattern == SPACED_PATTERN else None
        self.odd_space, self.part = regex.compile(r"\s ").search, regex.compile(r"(?<=\S) ").split
        size = self.machine.size
        self.size_of, self.start_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at, ranks = 0, self.machine.ranks
        for t, i in ranks.items():
            self.size_of[i], self.start_of[i] = len(t), at
            at += len(t)
        self.bytes_of = np.frombuffer(b"".join(ranks), np.uint8)

    def piece(self, text: str) -> bytes:
        return words(self.machine.encode(text.encode()))

    def run(self, text: str) -> bytes:
        parts = self.find(" " + text)
        if len(parts) == 1:
            return self.piece(parts[0])
        # A piece with a space before it is a run too.
        return b"".join([self.runs[p[1:]] if p[0] == " " and len(p) > 1 and not p.isspace() else self.pieces[p] for p in parts])

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def split(self, text: str) -> list[str]:
        return self.part(text) if self.odd_space(text) else text.split(" ")

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts):
        """Ids of each text. The runs of some texts, or of some of a long one, are looked up together."""
        if self.runs is None:
            yield from map(self.whole, texts)
            return
        some, n = [], 0
        for text in texts:
            parts = self.split(text)
            if n + len(parts) > MOST_RUNS:
                yield from self.joined(some)
                some, n = [], 0
            if len(parts) > MOST_RUNS:
                cuts = [self.joined([["", *parts[a : a + MOST_RUNS]]]) for a in range(1, len(parts), MOST_RUNS)]
                yield self.whole(parts[0]) + b"".join(chain.from_iterable(cuts))
            else:
                some.append(parts)
                n += len(parts)
        yield from self.joined(some)

    def joined(self, texts: list[list[str]]):
        self.prepare({r for parts in texts for r in parts[1:]})
        for parts in texts:
            yield self.whole(parts[0]) + b"".join(map(self.runs.__getitem__, parts[1:]))

    def prepare(self, every: set[str]) -> None:
        """Encodes those of the runs that the table lacks, together. It leaves out long ones, which
        aren't kept, and those with spaces in them or white space at an end: in a string of
        others, each separated by a space, just the first piece of each run begins with a space."""
        runs, pieces = self.runs, self.pieces
        new = [r for r in every if r not in runs]
        if runs.size + 300 * len(new) > runs.most:
            runs.empty()
            new = list(every)
        new = [r for r in new if r and len(r) <= LONGEST_RUN and " " not in r and r == r.strip()]
        if not new:
            return
        found = self.find(" " + " ".join(new))
        lacking = [p for p in dict.fromkeys(found) if (p[1:] not in runs if p[0] == " " else p not in pieces)]
        made = dict(zip(lacking, self.machine.encode_all([p.encode() for p in lacking]), strict=True))
        for p, ids in made.items():
            if p[0] == " ":
                runs.add(p[1:], ids)
            else:
                pieces.add(p, ids)
        of_run = []
        starts = [k for k, p in enumerate(found) if p[0] == " "]
        for r, a, b in zip(new, starts, [*starts[1:], len(found)], strict=True):
            if b - a > 1:
                first = found[a]
                ids = made[first] if first in made else runs[first[1:]]
                of_run.append((r, ids + b"".join([made[p] if p in made else pieces[p] for p in found[a + 1 : b]])))
        for r, ids in of_run:
            runs.add(r, ids)

    def decode(self, ids: bytes, step: int = 1 << 16):
        """The text's bytes in whole characters, as the ids arrive."""
        stream = Utf8Stream()
        every = np.frombuffer(ids, "<u4")
        for a in range(0, len(every), step):
            part = every[a : a + step]
            sizes = self.size_of[part]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.start_of[part] - ends + sizes, sizes)
            yield stream.feed(self.bytes_of[at].tobytes())
        yield stream.close()


class Utf8Stream:
    """An incremental UTF-8 state machine: `feed` gives the bytes up to the last whole character
    and keeps the up to three bytes of an unfinished one. Bytes that can't be UTF-8 pass through."""

    def __init__(self):
        self.kept = b""

    @staticmethod
    def need(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a lead byte, and the bounds of the first of them (RFC 3629)."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def feed(self, data: bytes) -> bytes:
        data = self.kept + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if not 0x80 <= byte <= 0xBF:
                follow, low, high = self.need(byte)
                if follow >= back and (back == 1 or low <= data[cut - back + 1] <= high):
                    cut -= back
                break
        self.kept = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        left, self.kept = self.kept, b""
        return left


@contextmanager
def without_collector():
    """The tables hold many small objects and no garbage in circles: cycle searches only cost."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def codec(path: str, pattern: str, most_bytes: tuple[int, int]) -> Codec:
    """One a Python worker."""
    return kept(("bpe", path, pattern, most_bytes), lambda: Codec(path, pattern, most_bytes))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, most_bytes: tuple[int, int] = MOST_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digests of the ids and of the
    bytes that they decode to, for each row of docs. No row moves: each task encodes what it reads.
    most_bytes bounds each worker's tables of pieces and runs; smaller ones cost time only."""
    return encoded(docs, path, pattern, True, most_bytes)


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encode_texts without the ids."""
    return encoded(docs, path, pattern, False)


def encoded(docs: DataFrame, path: str | None, pattern: str | None, with_ids: bool, most_bytes: tuple[int, int] = MOST_BYTES) -> DataFrame:
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern, most_bytes)
        for batch in batches:
            sizes, of_ids, of_text, kept_ids = [], [], [], []
            with without_collector():
                for ids in c.encode_all(text.as_py() or "" for text in batch.column("text")):
                    h = hashlib.sha256()
                    for part in c.decode(ids):
                        h.update(part)
                    sizes.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(h.hexdigest())
                    if with_ids:
                        kept_ids.append(ids)
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(sizes, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(kept_ids, pa.binary())
            yield pa.record_batch(out | {"ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    ids = "ids binary, " if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
