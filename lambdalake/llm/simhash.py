"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within one bit of it (half the radius of two); those
that meet at a variant are within two bits of each other. The members met at a variant are kept as one bit
set of the flipped bits, so a variant's group has 65 members at most, whatever the data. Each group gives
links to its least member, which are deduplicated and verified; components of the links are the classes.
Exact copies share a fingerprint and never multiply links.

Null and empty texts have the fingerprint zero and link like any other; repeated doc_ids are rows like any others, of which
each gets the component of its own fingerprint. Texts are whole, of any length; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import kernels as K
from .components import components
from .tables import materialize, partitions, unused, with_row

SHINGLE, SEED = 3, 42


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_spans(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, offsets by document): shingles of ``size`` words joined by one blank, as spans of
    a text of all words; fewer words are one shingle."""
    start, end = K.words(data, offsets)
    length = end - start
    text = np.full(int(length.sum()) + len(length), 32, np.uint8)
    at = np.cumsum(length + 1) - length - 1
    text[K.ragged(at, length)] = data[K.ragged(start, length)]
    first = np.searchsorted(start, offsets, "left")
    n = np.diff(first)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    i = K.ragged(first[:-1], shingles)
    last = np.minimum(i + size, np.repeat(first[1:], shingles)) - 1
    return text, at[i], at[last] + length[last], np.concatenate([[0], np.cumsum(shingles)])


def fingerprints(docs: DataFrame, size: int = SHINGLE, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ``also``, fp); the columns ``also`` are longs. A-Z lower-cased, words without white space, shingles with repeats, XXH64 with seed 42."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                text, start, end, own = shingle_spans(K.lower_ascii(data), offsets, size)
                view = memoryview(text)
                hashes = np.fromiter((xxh64_intdigest(view[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)), K.U, len(start))
                fp = [fingerprint(hashes[own[i] : own[i + 1]]) for i in range(len(offsets) - 1)]
                yield pa.record_batch([part.column(0), *part.columns[2:], pa.array(fp, pa.int64())], ["doc_id", *also, "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *also, "fp")))


def _masks() -> Column:
    return F.array(*[F.lit(np.int64(x).item()) for x in [0, *np.left_shift(np.int64(1), np.arange(64, dtype=np.int64)).tolist()]])


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join every two fingerprints within two bits, directly or over a common neighbour."""
    # Nearly all variants are different before the shuffle, so that pre-aggregating them would only take memory.
    n = partitions(fps.sparkSession)
    variants = fps.repartition(n, "fp").select("fp", F.explode(_masks()).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "mask")
    variants = variants.repartition(n, "variant")
    met = variants.groupBy("variant").agg(F.bit_or("mask").alias("flips"), F.max(F.col("mask") == 0).alias("own"))
    met = met.where(F.bit_count("flips") + F.col("own").cast("int") >= 2)
    flipped = F.filter(_masks(), lambda m: (m != 0) & (F.col("flips").bitwiseAND(m) != 0))
    members = F.transform(flipped, lambda m: F.col("variant").bitwiseXOR(m))
    met = met.select(F.when(F.col("own"), F.concat(F.array("variant"), members)).otherwise(members).alias("members"))
    pairs = met.select(F.array_min("members").alias("v"), F.explode("members").alias("u")).where("u != v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links lead to."""
    fps = materialize(fingerprints(docs, size), "fingerprints")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = materialize(ids, "fingerprint-ids")
    roots = materialize(components(links(known.select("fp"))), "roots").select(F.col("node").alias("fp"), "root")
    ids = known.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = materialize(ids, "classes")
    best = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.join(best, "root").select("fp", "component_id")
    return fps.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The documents without all but the first of each class: the row of the smallest doc_id (nulls last; of rows that share it, one)."""
    file, at = unused("__file", docs.columns), unused("__at", docs.columns)
    rows = with_row(docs, file, at)
    fps = materialize(fingerprints(rows.select("doc_id", "text", F.col(file).alias("file"), F.col(at).alias("at")), size, ["file", "at"]), "fingerprints")
    roots = materialize(components(links(fps.select("fp").distinct())), "roots").select(F.col("node").alias("fp"), "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at"))
    known = fps.groupBy("fp").agg(first.alias("first")).join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = known.select(F.col("first.file").alias(file), F.col("first.at").alias(at))
    return rows.join(kept, [file, at], "left_semi").select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
