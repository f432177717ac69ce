"""Operator 11: MinHash near-duplicates with odd sketches.

A text's set are its different five-word shingles (64-bit hashes). Texts with the same set (128-bit hash) are one node, so exact
copies never multiply pairs. ``BANDS`` bands of ``ROWS`` MinHashes each put a node in as many buckets; a pair at the
similarity misses all of them with probability below 1e-10 (``(1 - 0.85 ** ROWS) ** BANDS``), more similar pairs far more rarely.

Candidates go through an odd sketch: a node's ``SAMPLES`` least hashes (bottom-k MinHash samples) are folded into a bitmap of
``BITS`` parities. Elements that both samples have cancel in the XOR, so its ones never outnumber the elements in which the
samples differ, and for high similarities they are nearly as many. While both sets are whole in their samples, a pair at the
similarity differs in at most ``(100 - PERCENT) / (100 + PERCENT)`` of the sum of their sizes; more ones prove that it is not one.
For larger sets the bound is the expected difference of the samples and eight standard deviations. What is left is
verified on the whole sets.

Pairs within a bucket are not all emitted. The member in the most crowded buckets is the bucket's pivot (of copies with changes this is
their original), and the others are verified against it. Components of these links leave buckets with several components;
there, members outside the pivot's component are compared by sketch with all members of other components, in the join itself.

Fewer than five words are one shingle. Null texts and texts without words have the empty set: they are linked with nothing, and each
is its own component. Rows that share a doc_id get the component of their own text; a null doc_id gets the component's smallest other doc_id, or null.
Empty tables: no rows. Texts are whole, of any length; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import kernels as K
from .components import components
from .simhash import shingle_spans
from .tables import FOLDERS, materialize, settle

#: Words of a shingle; least similarity in per cent; bands and MinHashes of a band.
WORDS, PERCENT, BANDS, ROWS = 5, 85, 32, 4
#: Samples and bits of an odd sketch; most differences of two samples of larger sets.
SAMPLES, BITS = 1024, 2048
_UNION = SAMPLES * 100 / PERCENT
LARGE_DIFFER = int(2 * (_UNION * (100 - PERCENT) / 100 + 8 * (_UNION * PERCENT * (100 - PERCENT) / 1e4) ** 0.5))
#: Bytes of a key that the filter of ``needed_sets`` looks at (2 MB of bits).
FILTER_BYTES = 3


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(1, 2 * n + 1, dtype=K.U) * K.U(K.P1))
    return x[:n], x[n:] | K.U(1)


XOR, TIMES = _constants(BANDS * ROWS)


def min_hashes(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHashes of each non-empty row; row i has hashes[own[i]:own[i + 1]]."""
    first = own[:-1]
    out = np.empty((len(first), len(XOR)), K.U)
    for k in range(len(XOR)):
        out[:, k] = np.minimum.reduceat((hashes ^ XOR[k]) * TIMES[k], first) if len(first) else 0
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band, different ones in different bands."""
    n = len(minima)
    out = np.tile(np.arange(1, BANDS + 1, dtype=K.U) * K.U(K.P2), (n, 1))
    for r in range(ROWS):
        out = K.mix((out ^ minima.reshape(n, BANDS, ROWS)[:, :, r]) * K.U(K.P1) + K.U(1))
    return out


def odd_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """BITS parities of each set's SAMPLES least hashes, as 64-bit words; sets are sorted."""
    size = np.array([min(len(s), SAMPLES) for s in sets], np.int64)
    sample = np.concatenate([s[:SAMPLES] for s in sets] + [np.zeros(0, K.U)])
    slot = (K.mix(sample ^ K.U(K.M2)) % K.U(BITS)).astype(np.int64) + np.repeat(np.arange(len(sets)) * BITS, size)
    parity = (np.bincount(slot, minlength=len(sets) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8").reshape(len(sets), BITS // 64)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sorted different shingle hashes of each row, and the key of each set; no key for empty ones."""
    text, start, end, own = shingle_spans(K.lower_ascii(data), offsets, WORDS)
    hashes = K.span_hashes(K.chunks(text), text, start, end)
    sets = [np.unique(hashes[own[i] : own[i + 1]]) for i in range(len(offsets) - 1)]
    return sets, [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, bands, sketch) of each row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                sets, keys = _sets(data, offsets)
                n = np.array([len(s) for s in sets], np.int64)
                some = [s for s in sets if len(s)]
                own = np.append(0, np.cumsum(n[n > 0]))
                band = bands(min_hashes(np.concatenate([*some, np.zeros(0, K.U)]), own)).view(np.int64)
                at, empty = np.cumsum(n > 0), n == 0

                def lists(values: np.ndarray) -> pa.Array:
                    ends = np.append(0, at * values.shape[1]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(empty, False)), pa.array(values.ravel()))

                yield pa.record_batch([part.column(0), pa.array(keys, pa.binary()), pa.array(n), lists(band), lists(odd_sketch(some))], ["doc_id", "key", "n", "bands", "sketch"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, key binary, n long, bands array<long>, sketch array<long>")


def needed_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) once for each of ``keys`` (key); a bitmap of fixed size, then the join, leave out other texts."""
    slot = F.conv(F.hex(F.substring("key", 1, FILTER_BYTES)), 16, 10).cast("long")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << 8 * FILTER_BYTES - 6, np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()

    def wanted(key: bytes | None) -> bool:
        if key is None:
            return False
        at = int.from_bytes(key[:FILTER_BYTES], "big")
        return bool(words[at >> 6] >> (at & 63) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in K.slices(batch):
                sets, found = _sets(data, offsets)
                take = [i for i, k in enumerate(found) if wanted(k)]
                yield pa.record_batch([pa.array([found[i] for i in take], pa.binary()), pa.array([sets[i].tobytes() for i in take], pa.binary())], ["key", "shingles"])

    once = docs.select("text").mapInArrow(run, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    return once.join(keys, "key", "left_semi")


def possible(a: str, b: str) -> Column:
    """Whether sizes and sketches of two nodes (columns n and sketch with suffixes) leave room for a link."""
    n_a, n_b = F.col(f"n{a}"), F.col(f"n{b}")
    ones = sum((F.bit_count(F.col(f"sketch{a}")[i].bitwiseXOR(F.col(f"sketch{b}")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col(f"sketch{a}")[0].bitwiseXOR(F.col(f"sketch{b}")[0])))
    whole = ones * (100 + PERCENT) <= (n_a + n_b) * (100 - PERCENT)
    sized = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    return sized & F.when(F.greatest(n_a, n_b) <= SAMPLES, whole).otherwise(ones <= LARGE_DIFFER)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets (node, shingles) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), K.U), np.frombuffer(b.as_buffer(), K.U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
            yield batch.select(["u", "v"]).filter(pa.array(good))
            K.release()

    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")).hint("merge") for x in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long")


def _sketched(rows: DataFrame, nodes: DataFrame, x: str) -> DataFrame:
    """With n and sketch of the node in column ``x``, under names that end in it."""
    return rows.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")).hint("merge"), x)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) of nodes at the similarity; any two such nodes are in one component of them."""
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    crowds = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = materialize(places.join(crowds.hint("merge"), "bucket"), "shared-buckets")
    rank = met.groupBy("node").agg(F.sum("m").alias("weight"))
    met = materialize(met.select("bucket", "node").join(rank.hint("merge"), "node"), "weighed-buckets")
    first = F.struct("weight", "node")
    pivots = met.groupBy("bucket").agg(F.max(first).alias("top")).select("bucket", F.col("top.node").alias("v"))
    star = met.select("bucket", F.col("node").alias("u")).join(pivots.hint("merge"), "bucket").where("u != v").select("u", "v").distinct()
    star = materialize(_sketched(_sketched(star, nodes, "u"), nodes, "v").where(possible("_u", "_v")).select("u", "v"), "star-pairs")

    keys = materialize(nodes.select("node", "key").join(rank.select("node"), "node", "left_semi"), "candidate-keys")
    sets = materialize(needed_sets(docs, keys.select("key")).join(keys, "key").select("node", "shingles"), "candidate-sets")
    near = materialize(verified(star, sets), "star-links")
    roots = materialize(components(near), "star-roots")

    met = met.join(roots.hint("merge"), "node", "left").select("bucket", "node", "weight", F.coalesce("root", "node").alias("root"))
    mixed = met.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.struct("weight", "node", "root")).alias("top"))
    mixed = mixed.where("a != b").select("bucket", F.col("top.root").alias("major"))
    met = materialize(met.select("bucket", "node", "root").join(mixed.hint("merge"), "bucket"), "mixed-buckets")
    u = _sketched(met.where("root != major").select("bucket", "major", F.col("node").alias("u"), F.col("root").alias("root_u")), nodes, "u")
    v = _sketched(met.select("bucket", F.col("node").alias("v"), F.col("root").alias("root_v")), nodes, "v")
    apart = (F.col("root_u") > F.col("root_v")) | ((F.col("root_v") == F.col("major")) & (F.col("root_u") != F.col("root_v")))
    rest = u.join(v.hint("merge"), "bucket").where(apart & possible("_u", "_v")).select("u", "v").distinct()
    return near.union(verified(materialize(rest, "rest-pairs"), sets))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links lead to."""
    since = len(FOLDERS)
    rows = materialize(signatures(docs), "signatures")
    one = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), *one).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    roots = materialize(components(links(docs, nodes)), "roots")
    known = nodes.select("node", "key", "least").join(roots.hint("merge"), "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    known = materialize(known, "classes")
    best = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(best.hint("merge"), "root").select("key", "component_id")
    linked = rows.where("n > 0").select("doc_id", "n", "key").join(known.hint("merge"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return settle(linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id")), "near-classes", since)


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sql() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE given AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS (SELECT id, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) AS s FROM given),
firsts AS (SELECT list_sort(s) AS s, min(id) AS node, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY ALL),
each AS (SELECT node, len(s) AS n, unnest(s) AS x FROM firsts),
often AS (SELECT x FROM each GROUP BY x HAVING count(*) > 1),
met AS (SELECT * FROM each SEMI JOIN often USING (x)),
pairs AS (SELECT a.node AS u, b.node AS v, count(*) AS shared, any_value(a.n) + any_value(b.n) AS n FROM met a JOIN met b USING (x) WHERE a.node != b.node GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * shared >= {PERCENT} * (n - shared)),
reach(u, v) AS (SELECT node, node FROM firsts UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
best AS (SELECT r.u AS node, min(f.least) AS component_id FROM reach r JOIN firsts f ON f.node = r.v GROUP BY r.u)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN firsts ON list_sort(sets.s) = firsts.s LEFT JOIN best USING (node)"""


REPORT_SQL = _sql()
