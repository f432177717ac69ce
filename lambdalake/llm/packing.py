"""Operator 10: packing documents into training sequences along a space-filling curve.

Each document's tokens are summed as hashed sign vectors in a few dimensions; the direction of the sum is
laid on a grid and numbered by the Hilbert curve. Documents are range-partitioned and sorted by that
number, ties (such as copies) by a hash of doc_id and then doc_id, so that a large group of copies spreads over
partitions. Each partition is one stream of tokens, cut every ``length``; only its last sequence is padded.

Null and empty texts are the end token alone. Repeated doc_ids are packed as the separate rows that they are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K
from .tables import materialize, partitions

LENGTH, END, DIMENSIONS, BITS = 1024, 0, 4, 10


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of non-negative integers below 2**bits, by the transpose
    form: undo the excess rotations bit by bit, Gray-decode, then interleave the axes' bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for axis in range(dims):
            high = (x[axis] & bit) != 0
            swap = (x[0] ^ x[axis]) & low
            x[0] ^= np.where(high, low, swap)
            if axis:
                x[axis] ^= np.where(high, 0, swap)
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> level) & 1
    return key


def project(ids: np.ndarray, offsets: np.ndarray, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Grid place of each document's hashed vector."""
    size = int(ids.max(initial=0)) + 1
    signs = np.empty((size, dims), np.float32)
    for d in range(dims):
        signs[:, d] = (K.mix(np.arange(size, dtype=K.U) * K.U(dims) + K.U(d + 1)) >> K.U(40)).astype(np.float32) / np.float32(1 << 23) - 1
    sums = np.zeros((len(offsets) - 1, dims))
    own = np.flatnonzero(np.diff(offsets))
    if len(own):
        for d in range(dims):
            sums[own, d] = np.add.reduceat(signs[ids, d], offsets[own], dtype=np.float64)
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    return ((unit + 1) / 2 * ((1 << bits) - 1)).round().astype(np.int64)


def added_tokens(path: str) -> dict[bytes, int]:
    """Texts and ids of the tokens that a tokenizer file adds to its vocabulary; its library matches them in running text."""
    with open(path, encoding="utf-8") as f:
        return {x["content"].encode(): x["id"] for x in json.load(f)["added_tokens"]}


def tokens(docs: DataFrame, ranks: str, added: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id, Hilbert key and the ids (with the end token) as little-endian unsigned 32-bit, or 16-bit where they fit."""

    def make(vocab: bpe.Vocabulary, part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        key = hilbert(project(ids, offsets), BITS)
        n = np.arange(len(offsets) - 1)
        own = np.full(len(ids) + len(n), END, np.uint16 if max(len(vocab.tokens), *(x + 1 for x in (added or {}).values()), 0) <= 65536 else np.uint32)
        own[np.arange(len(ids)) + np.repeat(n, np.diff(offsets))] = ids
        width = own.itemsize
        blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(((offsets + np.arange(len(offsets))) * width).astype(np.int32)), pa.py_buffer(own)])
        return pa.record_batch([part.column(0), pa.array(key), pa.array(np.full(len(n), width), pa.int32()), blob], ["doc_id", "key", "width", "ids"])

    return bpe.with_tokens(docs.selectExpr("cast(doc_id as long) doc_id", "text"), ranks, "doc_id long, key long, width int, ids binary", make, added)


def pack(docs: DataFrame, ranks: str, added: dict[bytes, int] | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with the ids themselves on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            width = int(batch.column(1)[0].as_py())
            blob, offsets = K.as_bytes(batch.column(2))
            ids = np.frombuffer(blob.tobytes(), "<u2" if width == 2 else "<u4").astype("<u4")
            begin = offsets[:-1] // width + at
            end = offsets[1:] // width + at
            pieces = (end - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            sequence = K.ragged(begin // length, pieces)
            lo, hi = np.maximum(begin[doc], sequence * length), np.minimum(end[doc], (sequence + 1) * length)
            text = ids.tobytes()
            parts = [text[a:b] for a, b in zip(((lo - at) * 4).tolist(), ((hi - at) * 4).tolist(), strict=True)]
            columns = [
                batch.column(0).take(pa.array(doc)),
                pa.array(lo - begin[doc]),
                pa.array(hi - lo),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array((end - begin)[doc]),
                pa.array(first + sequence),
                pa.array(lo - sequence * length),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names)
            at += len(ids)

    spark = docs.sparkSession
    rows = materialize(tokens(docs, ranks, added), "packing-tokens")
    order = rows.repartitionByRange(partitions(spark), "key", F.xxhash64("doc_id"), "doc_id").sortWithinPartitions("key", F.xxhash64("doc_id"), "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return order.select("doc_id", "width", "ids").mapInArrow(run, schema)
