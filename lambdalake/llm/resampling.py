"""Operator 12: importance resampling towards a target distribution, on hashed word features.

Features are all single words and pairs of words in a row, repeats counted; each falls into one of ``BUCKETS`` by the CRC-32 of
its bytes. A byte automaton finds them in whole Arrow buffers at once: a table of 256 classes says which bytes are ink, differences
of that mask are the word boundaries, and the table-driven CRCs of all words advance together, a byte a step; a pair's CRC
starts from its first word's. Words over ``LONG`` bytes are left to zlib, one call each, with the same result.

A bucket's gain is the log ratio of its smoothed share in the target and in the corpus; a document's weight is its mean
gain. Drawing without replacement in proportion to the weights is a sort by weight plus Gumbel noise, which is hashed from doc_id, so
that the draw does not depend on partitions. Counts are over all documents. The driver sees ``BUCKETS`` counts and a number for
each partition.

Null and empty texts have no features and weight 0. Rows that share a doc_id are documents of their own with the same noise; those
that tie in score are ordered by doc_id, null last, then by features. A null doc_id has the noise of an empty id. Empty tables:
no rows; an empty target only has smoothing. Texts are whole, of any length; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import FOLDERS, materialize, numbered, settle

BUCKETS, SHARE, LEAST_WORDS, SEED, LONG = 10_000, 25, 20, 7, 64
#: Classes of bytes: 0 blank, 1 ink. Letters, digits and all bytes of characters beyond ASCII are ink.
INK = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; none crosses a document."""
    ink = INK[data].view(np.int8)
    step = np.diff(ink, prepend=0, append=0)
    start, end = step[:-1] == 1, step[1:] == -1
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start[edge] |= ink[edge] == 1
    end[edge - 1] |= ink[edge - 1] == 1
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def advance(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span; ``state`` are those before."""
    state, size = state.copy(), end - start
    long = size > LONG
    live, at = np.flatnonzero(~long), 0
    live = live[np.argsort(-size[live], kind="stable")]
    ends = np.searchsorted(-size[live], -np.arange(1, LONG + 1), "right")
    s, c = start[live], state[live]
    while at < LONG and ends[at]:
        n = ends[at]
        c[:n] = CRC[(c[:n] ^ data[s[:n] + at]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
        at += 1
    state[live] = c
    for i in np.flatnonzero(long).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, its bucket, words of each row) of lower-cased texts; a row's features are not in order."""
    data = LOWER[data]
    start, end = boundaries(data, offsets)
    row = K.doc_of(offsets, start)
    one = advance(data, start, end, np.full(len(start), 0xFFFFFFFF, np.uint32))
    pair = np.flatnonzero(row[1:] == row[:-1])
    blank = CRC[(one[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = advance(data, start[pair + 1], end[pair + 1], blank)
    bucket = (np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)
    return np.concatenate([row, row[pair]]), bucket.astype(np.int64), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts; a task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in K.slices(batch):
                total += np.bincount(features(data, offsets)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    counts = bucket_counts(docs).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.union(bucket_counts(target).select("bucket", F.lit(0).cast("long"), "n"))
    counts = counts.union(docs.sparkSession.range(BUCKETS).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    counts = counts.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    counts = materialize(counts, "bucket-counts")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(all_s + BUCKETS)) / ((F.col("s") + 1) * F.lit(all_t + BUCKETS))
    # BUCKETS rows, whatever the data.
    got = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").toArrow()
    return got.column("gain").to_numpy()


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                row, bucket, n_words = features(data, offsets)
                n = np.bincount(row, minlength=len(n_words))
                order = np.argsort(row, kind="stable")
                sums = np.append(0, np.cumsum(gain[bucket[order]]))
                upto = np.append(0, np.cumsum(n))
                weight = (sums[upto[1:]] - sums[upto[:-1]]) // np.maximum(n, 1)
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(n_words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score)."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    return weights(docs, gains(docs, target)).withColumn("score", (F.col("weight") + gumbel).cast("long"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank): ``share`` per cent of the documents of ``least`` words have a rank."""
    rows = materialize(scores(docs, target), "scores")
    able = F.col("n_words") >= least
    drawn = share * rows.where(able).count() // 100
    placed = numbered(rows.where(able), "rank", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return placed.withColumn("rank", rank).union(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    since = len(FOLDERS)
    return settle(resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank"), "ranks", since)


def _sql() -> str:
    """The same with the CRC from its polynomial, over distinct features."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    raw = "list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)"
    return f"""WITH crc(i, c) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) t(i)),
table256 AS (SELECT list(c ORDER BY i) AS t FROM crc),
given AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, coalesce({words}, []) AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, coalesce({words}, []) FROM benchmark),
each AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM given),
counted AS (SELECT side, id, f, count(*) AS n FROM each GROUP BY ALL),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM counted), table256),
sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT sum(s) AS s, coalesce(sum(t), 0) AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(sums.t, 0) + 1)::DOUBLE * (total.s + {BUCKETS})::DOUBLE) / ((coalesce(sums.s, 0) + 1)::DOUBLE * (total.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums, total),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DECIMAL(38, 0)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM given LEFT JOIN weighed USING (id) WHERE side = 0),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (id)"""


REPORT_SQL = _sql()
