"""Hashes of words and word runs of whole texts, in numpy."""

from __future__ import annotations

import re

import numpy as np

#: So many bytes are hashed at a time, cut at white space.
BLOCK_BYTES = 1 << 19
#: What separates words, as the inside of a pattern's set.
SPACE = rb"\x20\x09-\x0D"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.n = base, 0
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, 2 * self.n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n - 1, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64))])
            self.n = n
        return self.up[:n], self.down[:n]


_BYTES = Powers(0x5851F42D4C957F2D)


def sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give the polynomial hash of any run of ``values``, and the factors that undo its place."""
    up, down = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def word_hashes(data: bytes, separators: bytes = SPACE, split=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and a 64-bit hash of every word of ``data``; ``split(raw, starts, ends)`` may cut words further."""
    gaps = re.compile(b"[" + separators + b"]")
    table = np.zeros(256, bool)
    table[[i for i in range(256) if gaps.match(bytes([i]))]] = True
    found, at = [], 0
    while at < len(data):
        gap = gaps.search(data, at + BLOCK_BYTES)
        end = gap.end() if gap else len(data)
        starts, ends, h = _block(np.frombuffer(data, np.uint8, end - at, at), table, split)
        found.append((starts + at, ends + at, h))
        at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block(raw: np.ndarray, table: np.ndarray, split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[True], table[raw], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if split is not None:
        starts, ends = split(raw, starts, ends)
    total, down = sums(raw.astype(np.uint64) + np.uint64(1), _BYTES)
    h = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * _M1)
