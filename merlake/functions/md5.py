"""MD5 of many k-mers at once."""

from __future__ import annotations

import numpy as np

#: Fixed values of MD5: turns of a round, and the sines.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_ASCII = np.frombuffer(b"ACGT", np.uint8).astype(np.uint32)


def first_words(codes: np.ndarray, k: int) -> np.ndarray:
    """The first 32 bits, the first byte the highest, of the MD5 of the k letters of ordered codes (k up to 31)."""
    words = [np.uint32(0)] * 16
    for i in range(k):
        letter = _ASCII[(codes >> 2 * (k - 1 - i)) & 3]
        words[i // 4] = words[i // 4] | (letter << np.uint32(8 * (i % 4)))
    words[k // 4] = words[k // 4] | np.uint32(0x80 << 8 * (k % 4))
    words[14] = np.uint32(8 * k)
    a, b, c, d = (np.full(len(codes), x, np.uint32) for x in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        known = words[g]
        f = f + a
        f += _SINES[i]
        if not isinstance(known, np.uint32) or known:
            f += known
        s = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return (a + _START[0]).byteswap()
