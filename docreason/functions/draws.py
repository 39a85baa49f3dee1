"""Hash draws in blocks: the MD5 of many texts that differ in a last number."""

from __future__ import annotations

import math

import numpy as np

# RFC 1321: additive constants, rotations, start.
_ADD = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32).reshape(64, 1)
_TURN = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32).reshape(4, 1)
# Numbers hashed at a time: their arrays stay in the processor's cache.
_STEP = 8192


def _block(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f = f + (a + (words[at] + _ADD[i]))
        turn = _TURN[i // 16, i % 4]
        a, b, c, d = d, b + ((f << turn) | (f >> (np.uint32(32) - turn))), b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _same_length(prefix: bytes, j: np.ndarray, n_digits: int) -> np.ndarray:
    size = len(prefix) + n_digits
    text = prefix + bytes(n_digits) + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
    words = [w.reshape(1) for w in np.frombuffer(text, "<u4").astype(np.uint32)]
    for at in range(size - 1, len(prefix) - 1, -1):
        rest = j // 10
        digit = (j - rest * 10 + 48).astype(np.uint32)
        words[at // 4] = words[at // 4] | (digit << np.uint32(8 * (at % 4)))
        j = rest
    state = list(_START)
    for i in range(0, len(words), 16):
        state = _block(state, words[i:i + 16])
    high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
    return ((high << np.uint64(32)) | low) >> np.uint64(4)


def md5_draws(prefix: bytes, start: int, stop: int) -> np.ndarray:
    """The first 15 hexadecimal digits (60 bits) of md5(prefix + str(j)) as
    numbers, for j in [start, stop)."""
    out = np.empty(max(0, stop - start), np.uint64)
    at = start
    while at < stop:
        n_digits = len(str(at))
        end = min(stop, at + _STEP, 10 ** n_digits)
        out[at - start:end - start] = _same_length(prefix, np.arange(at, end, dtype=np.int64), n_digits)
        at = end
    return out
