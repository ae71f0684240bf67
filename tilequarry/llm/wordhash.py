"""Words of many texts at once, as 64-bit hashes, and rolling hashes over them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE, _ROLL_A, _ROLL_B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: Bytes hashed at a time.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, and the number of words per text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turn = np.concatenate(([0], turn))
    starts, ends = turn[0::2], turn[1::2]
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        # Whole words of about CHUNK bytes; a longer word makes a longer chunk.
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        first, last = int(starts[a]), int(ends[b - 1])
        n = last - first
        up, down = _powers(CHUNK if n <= CHUNK else n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * up[:n], out=sums[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, borders))


def rolling(hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of every run of `size` words; those across texts are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    roll = _ROLL_B if second else _ROLL_A
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= roll
        out += hashes[k:n + k]
    return mix(out ^ _U(size))


def inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Which runs of `size` words lie inside one text."""
    n = int(counts.sum()) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(counts)), counts)
    return text[:n] == text[size - 1:]
