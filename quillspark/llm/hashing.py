"""Vectorised word and window hashes over the bytes of many texts at once.

A string's hash is the polynomial sum(T[byte] * B**k) modulo 2**64 over its bytes, taken from prefix
sums: (C[end] - C[start]) * B**-start. T holds random words and B is odd, so B has an inverse.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93 | 1)
TABLE = np.random.default_rng(20).integers(1, 2**64 - 1, 256, dtype=U)
#: For a second hash that agrees with the first by chance alone.
SECOND = np.random.default_rng(21).integers(1, 2**64 - 1, 256, dtype=U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k for k < n at least."""
    if int(base) not in _powers or len(_powers[int(base)][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        run = lambda b: np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, b, U))), dtype=U)
        _powers[int(base)] = run(base), run(U(pow(int(base), -1, 2**64)))
    return _powers[int(base)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data (bytes): maximal runs without white space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    d = np.diff(word)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Hash of each word; works through the bytes in segments, to bound the prefix sums' memory."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = ends[j - 1]
        up, down = powers(BASE, int(hi - lo))
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out ^ ((ends - starts).astype(U) * STEP))


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive items: the rolling hash in closed form."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(STEP, len(items))
    sums = np.zeros(len(items) + 1, U)
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def inside(owner: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each place stays in one text; owner: each place's text."""
    return owner[: len(owner) - width + 1] == owner[width - 1 :] if len(owner) >= width else np.empty(0, bool)


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places a flagged window covers; flags[i]: of the window from i on."""
    c = np.zeros(n + width, np.int64)
    np.cumsum(np.pad(flags.astype(np.int64), (width, n - len(flags))), out=c[:])
    return c[width:] > c[:n]
