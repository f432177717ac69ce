"""MD5 of many short texts at once, as arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: RFC 1321: constants of the 64 steps, turns to the left, the state at the start.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fits one block of 64, with its length.
SHORT = 55


def _blocks(words: np.ndarray) -> list[np.ndarray]:
    """The state after one block of each text; ``words`` has 16 rows of little-endian words, a column for each text."""
    a, b, c, d = (np.full(words.shape[1], s, np.uint32) for s in START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[at], out=f)
        np.add(f, np.uint32(SINES[i]), out=f)
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), START, strict=True)]


def md5_of_pairs(data: np.ndarray, offsets: np.ndarray, tails: list[bytes], wanted: np.ndarray) -> np.ndarray:
    """The MD5 of each head (``data`` from one offset to the next) and a tail after it, where ``wanted[head, tail]``: two unsigned
    halves for each pair, (2, tails, heads), which have the order of the hex digits. Others are 0."""
    lengths = np.diff(offsets)
    out = np.zeros((2, len(tails), len(lengths)), np.uint64)
    # Texts of one length lie side by side, so that a tail is laid behind them all at once.
    order = np.argsort(lengths, kind="stable")
    fits = order[lengths[order] + max(map(len, tails), default=0) <= SHORT]
    for i in order[len(fits) :].tolist():
        head = data[offsets[i] : offsets[i + 1]].tobytes()
        for j in np.flatnonzero(wanted[i]).tolist():
            out[:, j, i] = np.frombuffer(hashlib.md5(head + tails[j]).digest(), ">u8")
    # Byte p of a text is at [p // 4, text, p % 4].
    block = np.zeros((16, len(fits), 4), np.uint8)
    words, groups = block.view("<u4")[:, :, 0], []
    for length in np.unique(lengths[fits]).tolist():
        lo, hi = np.searchsorted(lengths[fits], [length, length + 1]).tolist()
        groups.append((length, lo, hi))
        for p in range(length):
            block[p // 4, lo:hi, p % 4] = data[offsets[fits[lo:hi]] + p]
    for j, tail in enumerate(tails):
        for length, lo, hi in groups:
            for p, byte in enumerate(tail + b"\x80", length):
                block[p // 4, lo:hi, p % 4] = byte
            for p in range(length + len(tail) + 1, min(-(-(length + len(tail) + 1) // 4) * 4, 56)):
                block[p // 4, lo:hi, p % 4] = 0
            words[-(-(length + len(tail) + 1) // 4) : 14, lo:hi] = 0
            words[14, lo:hi] = 8 * (length + len(tail))
        picked = wanted[fits, j]
        at, own = (fits, words) if picked.all() else (fits[picked], words[:, picked])
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in _blocks(own))
        out[0, j, at], out[1, j, at] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return out
