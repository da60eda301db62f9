"""Word hashes of whole Arrow batches, in numpy.

Words are runs of other characters than space and \\x09 to \\x0D.  A word's
hash is a polynomial over its bytes modulo 2**64, read off prefix sums, then
scrambled; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

# White space bytes; odd multipliers with their inverses modulo 2**64.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2**64 for i up to at least ``n``."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        ups = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            ups.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (ups[0], ups[1])
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], the same at any place."""
    _, down = powers(base, len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def words(data: np.ndarray, off: np.ndarray, line_breaks: bool = False):
    """(hash, owner) of every word; owners are texts, or with ``line_breaks``
    lines, in which case the number of lines before each text is returned too."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = None
    if line_breaks:
        breaks = data == 10
        upto = np.concatenate(([0], np.cumsum(breaks)))
        text = np.arange(len(off) - 1)
        before = np.append(upto[off[:-1]] + text, upto[off[-1]] + len(text))  # lines before each text
    word = ~SPACES[data]
    start = word.copy()
    start[1:] &= SPACES[data[:-1]] | edge[1:n]
    start = np.flatnonzero(start)
    end = word.copy()
    end[:-1] &= SPACES[data[1:]] | edge[1:n]
    end = np.flatnonzero(end) + 1
    prefix = sums(data.astype(np.uint64) + np.uint64(1), BASE)
    hashes = scramble(span(prefix, start, end, BASE) + (end - start).astype(np.uint64))
    owner = np.searchsorted(off, start, side="right") - 1
    if line_breaks:
        owner = owner + upto[start]
    return hashes, owner.astype(np.int64), before
