"""Elias-Fano sequences and the levels of an n-gram trie made of them, in memory-mapped files."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

U = np.uint64
LEVELS, LOWEST = 254, -8.0


def quantise(log10: np.ndarray) -> np.ndarray:
    """Log10 probabilities in one byte each: 0 is none, 1 to 255 are even steps from LOWEST to 0."""
    return (1 + np.rint(np.clip((log10 - LOWEST) / -LOWEST, 0, 1) * LEVELS)).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    """Probabilities; 0 for none."""
    return RESTORED[code]


RESTORED = np.where(np.arange(256) == 0, 0.0, 10.0 ** (LOWEST * (1 - (np.arange(256) - 1.0) / LEVELS)))


Keep = Callable[[np.ndarray], np.ndarray]


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary. ``keep`` places each array (for example in a
    memory-mapped file). The places of the unary part's zeros and ones are unpacked when it is first asked."""

    def __init__(self, values: np.ndarray, keep: Keep = lambda a: a):
        n = len(values)
        values = values.astype(U)
        top = int(values[-1]) if n else 0
        self.n, self.low_bits = n, max(0, (top // max(1, n)).bit_length() - 1)
        low = U(self.low_bits)
        place = (values >> low).astype(np.int64) + np.arange(n)
        self.highs = (top >> self.low_bits) + 1
        bits = np.zeros(-(-(n + self.highs + 1) // 64) * 64, np.uint8)
        bits[place] = 1
        packed = np.zeros(-(-n * self.low_bits // 64) + 2, U)
        if self.low_bits and n:
            value = values & ((U(1) << low) - U(1))
            at = np.arange(n, dtype=np.int64) * self.low_bits
            word, shift = at >> 6, (at & 63).astype(U)
            np.bitwise_or.at(packed, word, value << shift)
            spill = np.flatnonzero((at & 63) + self.low_bits > 64)
            np.bitwise_or.at(packed, word[spill] + 1, value[spill] >> (U(64) - shift[spill]))
        self.unary, self.low = keep(np.packbits(bits, bitorder="little")), keep(packed)
        self.before: np.ndarray | None = None

    def _open(self) -> None:
        if self.before is None:
            bits = np.unpackbits(self.unary, bitorder="little")
            zeros, ones = np.flatnonzero(bits == 0)[: self.highs], np.flatnonzero(bits)
            kind = np.int32 if len(bits) < 1 << 31 else np.int64
            #: How many values have a high part below each; the high part of each value.
            self.before = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(kind)
            self.high = (ones - np.arange(len(ones))).astype(kind)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return value & ((U(1) << U(self.low_bits)) - U(1))

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element that is not below each value (n if there is none), within [first, last) if given."""
        self._open()
        values = values.astype(U)
        high = np.minimum(values >> U(self.low_bits), U(self.highs)).astype(np.int64)
        low = values & ((U(1) << U(self.low_bits)) - U(1))
        a, b = self.before[high].astype(np.int64), self.before[np.minimum(high + 1, self.highs)].astype(np.int64)
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        while len(live := np.flatnonzero(a < b)):
            middle = (a[live] + b[live]) >> 1
            below = self.low_of(middle) < low[live]
            a[live] = np.where(below, middle + 1, a[live])
            b[live] = np.where(below, b[live], middle)
        return a

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at some indices."""
        self._open()
        return self.high[i].astype(U) << U(self.low_bits) | self.low_of(i)


class Level:
    """A level of a trie: the successors of numbered contexts, ``bits`` wide, kept as ``context << bits | successor`` in one
    Elias-Fano sequence, with each context's range by monotone pointers."""

    def __init__(self, contexts: int, keys: np.ndarray, bits: int, keep: Keep = lambda a: a):
        self.bits = bits
        self.pointers = EliasFano(np.searchsorted(keys, np.arange(contexts + 1, dtype=U) << U(bits)), keep)
        self.keys = EliasFano(keys, keep)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each successor in its context's range, -1 for strangers and for contexts below 0."""
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        if not self.keys.n or not len(known):
            return out
        context = context[known].astype(np.int64)
        keys = context.astype(U) << U(self.bits) | successor[known].astype(U)
        last = self.pointers.get(context + 1).astype(np.int64)
        at = self.keys.successor(keys, self.pointers.get(context).astype(np.int64), last)
        inside = np.flatnonzero(at < last)
        same = inside[self.keys.get(at[inside]) == keys[inside]]
        out[known[same]] = at[same]
        return out


class Store:
    """A task's own folder of memory-mapped arrays."""

    def __init__(self) -> None:
        self.folder, self.n = tempfile.TemporaryDirectory(), 0

    def keep(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        self.n += 1
        path = os.path.join(self.folder.name, str(self.n))
        array.tofile(path)
        return np.memmap(path, array.dtype, "r", shape=array.shape)

    def close(self) -> None:
        self.folder.cleanup()
