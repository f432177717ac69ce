"""Shared array kernels: whole texts as one UTF-8 byte array, words and hashes found without a loop.

Every kernel works on a slice of an Arrow batch that holds whole documents (``slices``), so that the
memory of a task depends on the longest document and not on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 20
U = np.uint64
#: Spans longer than this are hashed one by one.
LONG = 256
#: Odd multipliers of the polynomial hashes, and the rounds of the 64-bit finaliser of MurmurHash3 (fixed values).
P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
M1, M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; the memory stays with the worker


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about ``most`` bytes: (rows, bytes, offsets)."""
    data, offsets = as_bytes(batch.column(batch.schema.get_field_index(column)))
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    release()


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches laid together until they have ``most`` bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(as_bytes(batch.column(batch.schema.get_field_index(column)))[0])
        if held and size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()


def doc_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row number of each byte position (rows without bytes own none)."""
    return np.searchsorted(offsets, at, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs without bytes 0x20 and 0x09-0x0D; runs never cross documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ink & edge[:-1]
    start[1:] |= ink[1:] & ~ink[:-1]
    end = ink & edge[1:]
    end[:-1] |= ink[:-1] & ~ink[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(M1)
    x ^= x >> U(33)
    x *= U(M2)
    x ^= x >> U(33)
    return x


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as a number; zeros follow the end. No copy for each place is made."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def span_hashes(view: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: its bytes in chunks of eight, each mixed into what came before."""
    size = end - start
    out = mix((view[start] & MASKS[np.minimum(size, 8)]) + size.astype(U) * U(P1))
    live, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        chunk = view[start[live] + done] & MASKS[np.minimum(size[live] - done, 8)]
        out[live] = mix((out[live] ^ chunk) * U(P2) + U(P1))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def equal(view: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``start`` of one array are those from ``at`` of another (both as ``chunks``)."""
    out = ((view[start] ^ other[at]) & MASKS[np.minimum(size, 8)]) == 0
    live, done = np.flatnonzero(out & (size > 8)), 8
    while len(live):
        same = ((view[start[live] + done] ^ other[at[live] + done]) & MASKS[np.minimum(size[live] - done, 8)]) == 0
        out[live[~same]] = False
        done += 8
        live = live[same & (size[live] > done)]
    return out


def _same(view: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span number ``other`` of it."""
    size, at = end - start, start[other]
    short = size <= LONG
    if (size != size[other]).any() or not equal(view, start[short], view, at[short], size[short]).all():
        return False
    return all(np.array_equal(data[start[i] : end[i]], data[at[i] : at[i] + size[i]]) for i in np.flatnonzero(~short & (at != start)).tolist())


def identify(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each span, a span of each group, hash of each group): spans are in one group if and only if their
    bytes are equal. Groups are found by hash and compared byte by byte; should two contents share a hash, a
    dictionary of the bytes takes over."""
    view = chunks(data)
    hashes = span_hashes(view, data, start, end)
    order = np.argsort(hashes)
    head = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    first = order[head]
    hashes = hashes[first]
    if not _same(view, data, start, end, first[group]):
        known: dict[bytes, int] = {}
        group = np.fromiter((known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        _, first = np.unique(group, return_index=True)
        hashes = span_hashes(view, data, start[first], end[first])
    return group, first, hashes


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n2 = max(n, 2 * len(self.up), 1 << 16)
            out = []
            for base in (self.base, self.inverse):
                a = np.full(n2, base, U)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS = {P1: Powers(P1), P2: Powers(P2)}


class Rolling:
    """Polynomial hashes of any span of a byte array, modulo 2**64, then mixed. Different spans can share one, above all
    long ones of a repetitive make: good for grouping candidates, never to decide that bytes are equal."""

    def __init__(self, data: np.ndarray, base: int = P1):
        up, self.down = POWERS[base].get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Of all spans of k bytes, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the spans [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_mod(ids: np.ndarray, mod: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo ``mod``."""
    return np.fromiter((zlib.crc32(b"%d" % i) % mod for i in ids.tolist()), np.int64, len(ids))


def id_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The ids, and 1 beside each that is null."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return np.stack([column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], 1)
