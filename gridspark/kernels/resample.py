"""Draws with replacement by MD5, many at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
#: Digits that change from draw to draw of a block; those before them are the same in all of it.
DIGITS = 4
#: Longest message that one MD5 block takes.
ONE_BLOCK = 55


def _md5_head(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """First 32 bits, big-endian, of the MD5 of ``n`` messages of one block; ``words`` are its 16 words, arrays where they differ."""
    u = np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _START)
    f, t = np.empty(n, u), np.empty(n, u)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            w = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            w = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            w = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            w = words[7 * i % 16]
        f += a
        if isinstance(w, int):
            f += u(_SINES[i] + w & 0xFFFFFFFF)
        else:
            f += w
            f += u(_SINES[i])
        np.left_shift(f, u(_SHIFTS[i]), out=t)
        f >>= u(32 - _SHIFTS[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + u(_START[0])).byteswap()


def _digits(low: int, high: int, width: int) -> np.ndarray:
    """The decimal digits of low to high as little-endian words, the first digit in the lowest byte."""
    x, out = np.arange(low, high, dtype=np.uint32), np.zeros(high - low, np.uint32)
    for i in range(width):
        out |= (x // np.uint32(10 ** (width - 1 - i)) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * i)
    return out


def _heads(prefix: bytes, digits: np.ndarray, width: int) -> np.ndarray:
    at, n = len(prefix), len(digits)
    if at + width > ONE_BLOCK:
        return np.array([int.from_bytes(hashlib.md5(prefix + int(x).to_bytes(4, "little")[:width]).digest()[:4], "big") for x in digits], np.uint32)
    message = bytearray(64)
    message[:at] = prefix
    message[at + width] = 128
    message[56:] = (8 * (at + width)).to_bytes(8, "little")
    words: list[int | np.ndarray] = [int.from_bytes(message[i : i + 4], "little") for i in range(0, 64, 4)]
    k, off = divmod(at, 4)
    words[k] = np.uint32(words[k]) | (digits << np.uint32(8 * off))
    if 8 * off + 8 * width > 32:
        words[k + 1] = np.uint32(words[k + 1]) | (digits >> np.uint32(32 - 8 * off))
    return _md5_head(words, n)


def draws(seed: int, replicate: int, n: int) -> Iterator[np.ndarray]:
    """Which of ``n`` rows the ``n`` draws of a replicate take: the first 32 bits of the MD5 of ``seed:replicate:draw``, modulo ``n``."""
    prefix, size = f"{seed}:{replicate}:".encode(), 10**DIGITS
    for width in range(1, DIGITS + 1):
        low, high = (10 ** (width - 1) if width > 1 else 0), min(n, 10**width)
        if low < high:
            yield _heads(prefix, _digits(low, high, width), width).astype(np.int64) % n
    block = _digits(0, size, DIGITS)
    for q in range(1, -(-n // size)):
        yield _heads(prefix + str(q).encode(), block[: n - q * size], DIGITS).astype(np.int64) % n
