"""Operator 7: media columns of baseline JPEG.

``store`` writes bytes as the luminance of a baseline JPEG, one byte per 8x8 block: with a quantiser of 8 a
block's DC coefficient is its sample, so any decoder gives the bytes back. A row of 64 blocks is a restart interval.
``read`` parses markers and decodes scans of any baseline JPEG (any tables, components and AC coefficients) to
DC-only luminance thumbnails. Restart intervals of all files of a batch are decoded side by side in numpy: a step reads one
code and its bits for each of them by a table of 16-bit prefixes. A thumbnail's hash tells which cells of an 8x8 reduction exceed
its mean.

Null and empty texts are 64 zero bytes. Equal texts have equal files; repeated doc_ids are rows like any others. Longer
payloads than a file's 65,535 pixels a side can hold become several files on end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

UNIT, MOST_ROWS = 64, 8000
#: The luminance DC table of the standard's annex K: codes of each length from 1, and their symbols (fixed values).
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a canonical table."""
    out, code, k = [], 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((length, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a block and how many, for each difference -255..255: the DC code, its bits, and the end of the block (one 0)."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    known = {symbol: (length, code) for length, code, symbol in _codes(DC_COUNTS, DC_SYMBOLS)}
    for diff in range(-255, 256):
        n = abs(diff).bit_length()
        length, code = known[n]
        bits[diff + 255] = (code << n | (diff if diff >= 0 else diff + (1 << n) - 1)) << 1
        size[diff + 255] = length + n + 1
    return bits, size


BITS, SIZES = _block_bits()
HEAD = (
    b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])) + _segment(0xDB, bytes([0] + [8] * 64))
    + _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
)


def _head(rows: int) -> bytes:
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0]))
    return HEAD + frame + _segment(0xDD, struct.pack(">H", UNIT)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _intervals(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of UNIT samples, each coded for itself and filled up with ones, and where each row ends."""
    rows = samples.reshape(-1, UNIT).astype(np.int16) - 128
    diff = np.diff(rows, axis=1, prepend=np.int16(0)).astype(np.int64) + 255
    size = np.zeros((len(rows), UNIT + 1), np.int64)
    size[:, :UNIT] = SIZES[diff]
    size[:, UNIT] = -size.sum(1) % 8
    bits = np.concatenate([BITS[diff], ((1 << size[:, UNIT]) - 1)[:, None]], axis=1)
    ends = np.cumsum(size.sum(1)) >> 3
    size = size.ravel()
    at = np.cumsum(size) - size
    word = bits.ravel() << (24 - size - (at & 7))
    byte, out = at >> 3, np.zeros(int(ends[-1]) + 3 if len(ends) else 0, np.int64)
    for k in range(3):
        # No two codes share a bit, so adding them up lays them side by side.
        out += np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, len(out)).astype(np.int64)
    return out[: int(ends[-1]) if len(ends) else 0].astype(np.uint8), ends


def write_many(samples: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Stored forms of payloads of multiples of 64 bytes that stand on end: files of MOST_ROWS rows at most, on end."""
    raw, ends = _intervals(samples)
    counts = np.diff(offsets) // UNIT
    first = offsets[:-1] // UNIT
    row = np.arange(len(ends)) - np.repeat(first, counts)
    last = (row % MOST_ROWS == MOST_ROWS - 1) | (row == np.repeat(counts, counts) - 1)
    # A zero after each 255, and a marker after each row that is not a file's last.
    stuffed = np.flatnonzero(raw == 0xFF) + 1
    marked = np.flatnonzero(~last)
    where = np.concatenate([stuffed, np.repeat(ends[marked], 2)])
    what = np.concatenate([np.zeros(len(stuffed), np.uint8), np.stack([np.full(len(marked), 0xFF, np.uint8), (0xD0 + row[marked] % MOST_ROWS % 8).astype(np.uint8)], 1).ravel()])
    order = np.argsort(where, kind="stable")
    where, what = where[order], what[order]
    scan = np.insert(raw, where, what).tobytes()
    # A file's last row has no marker, but its end may be where a stuffed zero stands.
    moved = ends + np.searchsorted(where, ends, "right")
    begin = np.concatenate([[0], moved]).tolist()
    out = []
    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
        parts = []
        for lo in range(a, a + n, MOST_ROWS):
            hi = min(a + n, lo + MOST_ROWS)
            parts += [_head(hi - lo), scan[begin[lo] : begin[hi]], b"\xff\xd9"]
        out.append(b"".join(parts))
    return out


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def write(payload: bytes) -> bytes:
    """JPEG files on end that hold a payload of a multiple of 64 bytes."""
    return write_many(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]))[0]


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    restart: int = 0
    end: int = 0
    quants: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # counts and symbols
    components: list[Component] = field(default_factory=list)
    scan: bytes = b""


def parse(data: bytes, at: int = 0) -> Jpeg:
    """Markers of the baseline JPEG that begins at ``at``; its scan is kept with the stuffing."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Jpeg(), at + 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xD9:
            out.end = at + 2
            return out
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                out.quants[ident] = list(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + n]))
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            depth, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("not 8 bits")
            out.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (out.restart,) = struct.unpack(">H", body[:2])
        elif marker == 0xDA:
            for i in range(body[0]):
                for c in out.components:
                    if c.ident == body[1 + 2 * i]:
                        c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            stop = _scan_end(data, at)
            out.scan, at = data[at:stop], stop


def _scan_end(data: bytes, at: int) -> int:
    """Where the first marker stands that is neither a stuffed byte nor a restart."""
    while True:
        raw = np.frombuffer(data, np.uint8, min(len(data) - at, 1 << 18), at)
        after = raw[1:][raw[:-1] == 0xFF]
        found = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)))
        if len(found):
            return at + int(np.flatnonzero(raw[:-1] == 0xFF)[found[0]])
        if at + len(raw) >= len(data):
            raise ValueError("no end of scan")
        at += len(raw) - 1


_prefixes: dict[bytes, np.ndarray] = {}


def prefixes(table: bytes) -> np.ndarray:
    """For each 16 bits, the symbol that they begin with << 8 | its length; 0 where no code begins."""
    if table not in _prefixes:
        if len(_prefixes) > 64:
            _prefixes.clear()
        out = np.zeros(1 << 16, np.int64)
        for length, code, symbol in _codes(list(table[:16]), list(table[16:])):
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
        _prefixes[table] = out
    return _prefixes[table]


def _take(view: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code at each bit place: (symbol, the value of its bits, place after both)."""
    window = view[at >> 3].astype(K.U) << (at & 7).astype(K.U)
    got = table[(window >> K.U(48)).astype(np.int64)]
    if not got.all():
        raise ValueError("no such code")
    length, symbol = got & 255, got >> 8
    size = symbol & 15
    bits = ((window << length.astype(K.U)) >> K.U(1) >> (63 - size).astype(K.U)).astype(np.int64)
    return symbol, np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits), at + length + size


def _decode(jpegs: list[Jpeg], units: list[int], blocks: list[int]) -> list[np.ndarray]:
    """DC values of all blocks of files with the same tables and components, in the order of their scans. ``units`` has
    the component of each block of a unit, ``blocks`` how many each file has."""
    raw = np.frombuffer(b"".join(x.scan + b"\xff\xd0" for x in jpegs), np.uint8)
    after = np.concatenate([[0], raw[:-1]])
    zero = (after == 0xFF) & (raw == 0)
    mark = (after == 0xFF) & (raw >= 0xD0) & (raw <= 0xD7)
    gone = zero | mark
    gone[:-1] |= mark[1:]
    data = raw[~gone]
    place = np.concatenate([[0], np.cumsum(~gone)])
    ends = np.flatnonzero(mark)  # of the intervals; a file's last one by the marker that was laid after it
    begin = place[np.concatenate([[0], ends[:-1] + 1])] if len(ends) else np.zeros(0, np.int64)
    lanes = [-(-n // (x.restart * len(units))) if x.restart else 1 for x, n in zip(jpegs, blocks, strict=True)]
    if sum(lanes) != len(ends):
        raise ValueError("restarts and size do not agree")
    many = np.concatenate([np.minimum(np.full(k, x.restart * len(units) if x.restart else n), n - np.arange(k) * (x.restart or 0) * len(units)) for k, x, n in zip(lanes, jpegs, blocks, strict=True)])
    first, file_of = np.cumsum(many) - many, np.repeat(np.arange(len(jpegs)), lanes)
    order = np.argsort(-many, kind="stable")
    sizes, at, first = many[order], begin[order] * 8, first[order]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    view = np.ndarray((len(data) + 8,), ">u8", padded.data, 0, (1,))
    one = jpegs[0]
    tables = [(prefixes(one.tables[c.dc]), prefixes(one.tables[16 | c.ac])) for c in one.components]
    out, last = np.zeros(int(many.sum()), np.int64), np.zeros((len(one.components), len(at)), np.int64)
    for u in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -u, "left"))
        c = units[u % len(units)]
        dc, ac = tables[c]
        _, diff, at[:n] = _take(view, at[:n], dc)
        last[c, :n] += diff
        out[first[:n] + u] = last[c, :n]
        live, coefficient = np.arange(n), np.ones(n, np.int64)
        while len(live):
            symbol, _, at[live] = _take(view, at[live], ac)
            coefficient[live] += (symbol >> 4) + 1
            live = live[(symbol != 0) & (coefficient[live] < 64)]
    cuts = np.cumsum(np.bincount(file_of, many, len(jpegs)).astype(np.int64))[:-1]
    return np.split(out, cuts)


def _grid(jpeg: Jpeg) -> tuple[int, int, list[int], int]:
    """(rows, columns) of the first component's blocks, the component of each block of a unit, and the number of blocks."""
    first, alone = jpeg.components[0], len(jpeg.components) == 1
    most_h, most_v = max(c.across for c in jpeg.components), max(c.down for c in jpeg.components)
    wide, high = -(-jpeg.width * first.across // (8 * most_h)), -(-jpeg.height * first.down // (8 * most_v))
    if alone:
        return high, wide, [0], high * wide
    units = [k for k, c in enumerate(jpeg.components) for _ in range(c.across * c.down)]
    return high, wide, units, len(units) * -(-wide // first.across) * -(-high // first.down)


def thumbnails(jpegs: list[Jpeg]) -> list[np.ndarray]:
    """DC-only luminance of each: one sample for each 8x8 block."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(jpegs)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(jpegs):
        groups.setdefault((*((c.across, c.down, x.tables[c.dc], x.tables[16 | c.ac]) for c in x.components),), []).append(i)
    for own in groups.values():
        grids = [_grid(jpegs[i]) for i in own]
        for i, (high, wide, units, _), dc in zip(own, grids, _decode([jpegs[i] for i in own], grids[0][2], [g[3] for g in grids]), strict=True):
            first = jpegs[i].components[0]
            if len(units) > 1:
                h, v = first.across, first.down
                across = -(-wide // h)
                dc = dc.reshape(-1, across, len(units))[:, :, : h * v].reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:high, :wide]
            out[i] = np.clip(np.rint(dc.reshape(high, wide) * jpegs[i].quants[first.quant][0] / 8 + 128), 0, 255).astype(np.uint8)
    return out


def thumbnail(jpeg: Jpeg) -> np.ndarray:
    return thumbnails([jpeg])[0]


def average_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8x8 reduction exceed their mean."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    sums = np.concatenate([np.zeros((1, thumb.shape[1])), np.cumsum(thumb, axis=0, dtype=np.float64)])
    sums = np.concatenate([np.zeros((len(sums), 1)), np.cumsum(sums, axis=1)], axis=1)
    r0, r1 = rows[:-1], np.minimum(np.maximum(rows[1:], rows[:-1] + 1), thumb.shape[0])
    r0 = np.minimum(r0, r1 - 1)
    c0, c1 = cols[:-1], np.minimum(np.maximum(cols[1:], cols[:-1] + 1), thumb.shape[1])
    c0 = np.minimum(c0, c1 - 1)
    cells = (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def files(data: bytes) -> list[Jpeg]:
    """The files that stand on end."""
    out, at = [], 0
    while at < len(data):
        out.append(parse(data, at))
        at = out[-1].end
    return out


def read(media: list[bytes]) -> list[dict[str, object]]:
    """What the columns of stored forms say: dimensions, samples, thumbnail hash."""
    found = [files(x) for x in media]
    thumbs, out = iter(thumbnails([x for own in found for x in own])), []
    for own in found:
        samples = np.concatenate([next(thumbs).ravel() for _ in own])
        width = -(-own[0].width // 8)
        thumb = samples.reshape(-1, width) if len(samples) % width == 0 else samples.reshape(1, -1)
        out.append({"width": own[0].width, "height": sum(f.height for f in own), "samples": samples.tobytes(), "hash": average_hash(thumb)})
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each whole text in its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                size = np.diff(offsets)
                ends = np.concatenate([[0], np.cumsum(size + np.where(size > 0, -size % UNIT, UNIT))])
                payload = np.zeros(int(ends[-1]), np.uint8)
                payload[K.ragged(ends[:-1], size)] = data
                yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(write_many(payload, ends), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def columns(docs: DataFrame) -> DataFrame:
    """Store every text in a media column, read that column back, and describe it."""

    def row(n: int, media: bytes, got: dict) -> tuple:
        payload = got["samples"]
        feature = f"jpeg {got['width']}x{got['height']} {got['hash']}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for part, _, _ in K.slices(batch, "media"):
                media = part.column(2).to_pylist()
                out = list(zip(*map(row, part.column(1).to_pylist(), media, read(media)), strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store(docs).mapInArrow(run, schema)
