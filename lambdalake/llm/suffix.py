"""Operator 4: repeated passages by suffix sorting with bucket-pointer refinement.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere. Each such window is
given to its anchor: the leftmost of the least hashes of its ``GRAM``-byte strings. Equal windows have equal
anchors at equal places, so only windows of one anchor need comparing; neighbouring windows of one anchor
form a segment. Then, without any group in one task:

1. anchors are counted (pre-aggregated); those that occur once are done;
2. segments of one content (128 bits of XXH3 under their anchor) that occur twice are removed whole, wherever they stand;
3. segments that occur once, and one of each repeated content, are compared with the other segments of
   their anchor: their bytes are laid on end per shard and their suffixes bucketed by 8-byte strings; buckets
   of two and more are refined by sorting on the bucket numbers of later offsets (8, 16, ... bytes on), which the
   buckets after them use at once, until they stand for ``LENGTH`` bytes; neighbours in this order are compared byte by byte;
4. segments of anchors with more than ``CROWD`` different ones are cut into blocks of ``STEP`` windows, which
   go through the same steps anchored on the 193 bytes that their windows share; blocks of anchors that are
   crowded again are compared window by window, by counting 128-bit hashes, which splits evenly.

Anchors and contents that have a large part of all rows are joined by a broadcast of these few keys, all others by a shuffle.

Null and empty texts have no bytes. Texts are whole, of any length; positions are bytes of UTF-8. Rows are told apart by a number
of their own, so repeated doc_ids and repeated rows are texts like any others. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import kernels as K
from .tables import materialize, partitions, unused

LENGTH, GRAM, CROWD, STEP, BLOCK_BYTES = 200, 32, 256, 8, 1 << 20
PLACE_BITS = 24


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(doc, start, windows, anchor place, anchor hash) of all segments; starts are places in ``data``."""
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(K.U)
    rolling = K.Rolling(data)
    hashes = rolling.grams(gram)
    place_bits = max(PLACE_BITS, n.bit_length())
    places = (K.U(1) << K.U(place_bits)) - K.U(1)
    ranked = hashes & ~places | np.arange(len(hashes), dtype=K.U)
    # Least of every ``span`` on end: minima from the left and from the right within blocks.
    full = -(-len(ranked) // span) * span
    padded = np.full(full, ~K.U(0), K.U)
    padded[: len(ranked)] = ranked
    grid = padded.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(right[:windows], left[span - 1 : span - 1 + windows])
    anchor = (least & places).astype(np.int64)
    ends = np.zeros(n + 1, np.int64)
    ends[offsets[1:]] = 1
    # A window is whole if no document ends inside it.
    upto = np.cumsum(ends)
    whole = upto[length - 1 : length - 1 + windows] == upto[:windows]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    if not len(at):
        return none, none, none, none, none.view(K.U)
    stops = np.append(np.flatnonzero(new | ~whole), windows)
    count = stops[np.searchsorted(stops, at, "right")] - at
    return K.doc_of(offsets, at), at, count, anchor[at], hashes[anchor[at]]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span, in two halves."""
    view = memoryview(np.ascontiguousarray(data))
    wide = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(wide[:, 0]), np.ascontiguousarray(wide[:, 1])


def find_segments(docs: DataFrame) -> DataFrame:
    """(row, start, windows, place, anchor, content, more): start counts from the text's first byte, place from the segment's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, most=BLOCK_BYTES):
                doc, start, windows, place, anchor = segments(data, offsets)
                content, more = digests(data, start, start + windows + LENGTH - 1)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(doc)),
                        pa.array((start - offsets[doc]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((place - start).astype(np.int32)),
                        pa.array(anchor.view(np.int64)), pa.array(content), pa.array(more),
                    ],
                    ["row", "start", "windows", "place", "anchor", "content", "more"],
                )

    return docs.select("row", "text").mapInArrow(run, "row long, start int, windows int, place int, anchor long, content long, more long")


def refine(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int = LENGTH, parts: int = 4) -> np.ndarray:
    """For all windows of spans of ``data`` (a span has ``count`` windows and ``count + length - 1`` bytes):
    bucket numbers, equal if and only if the windows are equal.

    Initial buckets are 8-byte strings, numbered by their order. A pass goes through the open buckets, some at a time, and sorts
    their places by (own bucket, bucket of a later offset); the new numbers are what the following buckets of the same pass see.
    Doubling the offset at least doubles the bytes that buckets stand for, and places alone in a bucket are settled. In the order
    of the final buckets equal windows are neighbours, and neighbours are compared byte by byte."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.data, 0, (1,)).astype(K.U)
    order = np.argsort(key, kind="stable")
    step = np.ones(n, bool)
    step[1:] = key[order][1:] != key[order][:-1]
    bucket = np.empty(n, np.int64)
    bucket[order] = np.maximum.accumulate(np.where(step, np.arange(n), 0))
    sizes = np.diff(np.append(np.flatnonzero(step), n))
    places, depth = order[np.repeat(sizes, sizes) > 1], 8
    while depth < length and len(places):
        heads = np.flatnonzero(np.append(True, bucket[places[1:]] != bucket[places[:-1]]))
        cuts = np.unique(np.append(heads[np.searchsorted(heads, np.arange(parts) * len(places) // parts, "right") - 1], len(places)))
        left = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = places[lo:hi]
            # Offsets beyond the data count as a bucket of their own; spans keep windows clear of them.
            second = np.where(own + depth < n, bucket[np.minimum(own + depth, n - 1)], -1)
            order = np.lexsort((second, bucket[own]))
            own, first, second = own[order], bucket[own][order], second[order]
            head = np.append(True, first[1:] != first[:-1])
            step = head.copy()
            step[1:] |= second[1:] != second[:-1]
            index = np.arange(len(own))
            start = np.maximum.accumulate(np.where(head, index, 0))
            bucket[own] = first + np.maximum.accumulate(np.where(step, index, 0)) - start
            sizes = np.diff(np.append(np.flatnonzero(step), len(own)))
            left.append(own[np.repeat(sizes, sizes) > 1])
        places = np.concatenate(left)
        depth *= 2
    at = K.ragged(starts, counts)
    order = np.argsort(bucket[at], kind="stable")
    a, b = at[order][:-1], at[order][1:]
    live = np.arange(len(a))
    for k in (*range(0, length - 8, 8), max(0, length - 8)):
        live = live[key[a[live] + k] == key[b[live] + k]]
    new = np.ones(len(at), bool)
    new[live + 1] = False
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new)
    return out


SPANS = "row long, start int, stop int"


def _compare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of the segments (anchor, row, start, windows, alone, bytes) of whole anchors; only ``alone`` ones are reported."""
    data, offsets = K.as_bytes(batch.column(5))
    start, counts = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
    bucket = refine(data, offsets[:-1], counts)
    twice = np.bincount(bucket)[bucket] > 1
    segment = np.repeat(np.arange(len(counts)), counts)
    found = np.flatnonzero(twice & batch.column(4).to_numpy(zero_copy_only=False)[segment])
    segment = segment[found]
    head = np.append(True, (found[1:] != found[:-1] + 1) | (segment[1:] != segment[:-1]))[: len(found)]
    tail = np.append(head[1:], True)[: len(found)]
    place = found - (np.cumsum(counts) - counts)[segment] + start[segment]
    return pa.record_batch([batch.column(1).take(pa.array(segment[head])), pa.array(place[head].astype(np.int32)), pa.array((place[tail] + LENGTH).astype(np.int32))], ["row", "start", "stop"])


def _compare_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by anchor, in blocks of whole anchors of about BLOCK_BYTES."""
    rest = None
    for batch in K.gathered(batches, "data", BLOCK_BYTES):
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        anchor = batch.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield _compare(batch.slice(0, cut))
        rest = batch.slice(cut)
    if rest is not None:
        yield _compare(rest)


def _matched(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns that ``table`` (written out, a row for each key) has for their keys (inner). Keys with more
    than a partition's share of the weight, one for each partition at most, are broadcast; the others meet by a shuffle."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = table.where(F.col(weight) * partitions(rows.sparkSession) > total)
    hot = [r[0] for r in heavy.select(F.xxhash64(*keys)).collect()]
    table = table.drop(weight)
    if not hot:
        return rows.join(table.hint("merge"), keys)
    is_hot = F.xxhash64(*keys).isin(hot)
    return rows.where(~is_hot).join(table.where(~is_hot).hint("merge"), keys).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), keys))


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose anchor occurs twice or more, with whether all of its rows have one content."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("content", "more") for n, f in (("low", F.min), ("high", F.max))]
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    anchors = anchors.select("anchor", "n", F.expr("low_content = high_content and low_more = high_more").alias("uniform"))
    return materialize(_matched(rows, materialize(anchors, f"{name}-anchors"), ["anchor"], "n"), name)


CONTENT = ["anchor", "content", "more"]


def _contents(mixed: DataFrame, name: str) -> DataFrame:
    """(anchor, content, more, n, first): the different contents of anchors that have several."""
    columns = [c for c in ("row", "start", "windows", "place") if c in mixed.columns]
    return materialize(mixed.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*columns)).alias("first")), name)


def _whole(again: DataFrame, contents: DataFrame) -> DataFrame:
    """Spans of the rows whose content occurs twice or more."""
    copies = contents.where("n > 1").select(*CONTENT, "n")
    spans = [x.select("row", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).cast("int").alias("stop")) for x in (again.where("uniform"), _matched(again.where("not uniform"), copies, CONTENT, "n"))]
    return spans[0].union(spans[1])


def _members(contents: DataFrame) -> DataFrame:
    """``contents`` with ``members``, how many their anchor has."""
    crowd = materialize(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")), "crowds")
    return _matched(contents, crowd.withColumn("weight", F.col("members")), ["anchor"], "weight")


def _sorted_spans(rows: DataFrame) -> DataFrame:
    """Spans by suffix sorting of (anchor, row, start, windows, alone, data), anchors of CROWD rows at most."""
    columns = rows.select("anchor", "row", "start", "windows", "alone", "data")
    return columns.repartition(partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(_compare_shard, SPANS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of each row that stays."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def removals(docs: DataFrame) -> DataFrame:
    """(row, spans): the byte spans that go, unmerged, of the rows (row, text) that lose any."""
    docs = docs.select("row", "text")
    again = _repeated(materialize(find_segments(docs), "segments"), "repeated")
    contents = _contents(again.where("not uniform"), "contents")
    # One of each content goes on, with its bytes.
    wanted = _members(contents).select(
        F.col("first.row").alias("row"),
        F.struct("anchor", "first.start", "first.windows", "first.place", (F.col("n") == 1).alias("alone"), (F.col("members") > CROWD).alias("crowded")).alias("want"),
    )
    wanted = wanted.groupBy("row").agg(F.collect_list("want").alias("want"))
    cut = materialize(docs.join(wanted.hint("merge"), "row").mapInArrow(_cut, CUT), "cut-segments")
    spans = _whole(again, contents).union(_sorted_spans(cut.where("content is null"))).union(_crowded(cut.where("content is not null")))
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _crowded(blocks: DataFrame) -> DataFrame:
    """Spans of the blocks of crowded anchors: the same steps, anchored on the bytes that all windows of a
    block share; where a block's anchor is crowded again, its windows are counted one by one."""
    again = _repeated(blocks, "repeated-blocks")
    contents = _contents(again.where("not uniform"), "block-contents")
    # The bytes of one of each content: its first place is where the block stands itself, so this join finds one row each.
    one = _members(contents).select("anchor", "members", "n", F.col("first.row").alias("row"), F.col("first.start").alias("start")).hint("merge")
    one = again.where("not uniform").join(one, ["row", "start", "anchor"]).withColumn("alone", F.col("alone") & (F.col("n") == 1))
    one = materialize(one.select("anchor", "row", "start", "windows", "alone", "data", "members"), "blocks-once")
    windows = materialize(one.where(F.col("members") > CROWD).select("row", "start", "windows", "alone", "data").mapInArrow(_windows, WINDOWS), "windows")
    twice = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = _matched(windows.where("alone"), materialize(twice, "repeated-windows"), ["a", "b"], "n").select("row", "start", (F.col("start") + LENGTH).cast("int").alias("stop"))
    return _whole(again.where("alone"), contents).union(_sorted_spans(one.where(F.col("members") <= CROWD))).union(many)


CUT = "anchor long, row long, start int, windows int, alone boolean, data binary, content long, more long"
WINDOWS = "row long, start int, alone boolean, a long, b long"


def _binary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[K.ragged(begin, size)]))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments; those of crowded anchors in blocks of STEP windows, whose anchor is the
    hash of the bytes that all windows of the block share. Blocks are counted from the segment's anchor, so that
    equal windows are in blocks of one anchor."""
    names = ["anchor", "row", "start", "windows", "alone", "data", "content", "more"]
    for batch in batches:
        for part, data, offsets in K.slices(batch, most=BLOCK_BYTES):
            want = part.column(2)
            cuts = np.asarray(want.offsets).astype(np.int64)
            get = lambda name: want.values.field(name).to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]]  # noqa: B023, E731
            doc = np.repeat(np.arange(part.num_rows), np.diff(cuts))
            anchor, start, count, place = (get(x).astype(np.int64) for x in ("anchor", "start", "windows", "place"))
            alone, crowded = get("alone").astype(bool), get("crowded").astype(bool)
            begin, ids = offsets[doc] + start, part.column(0).to_numpy(zero_copy_only=False)[doc]
            few, many = np.flatnonzero(~crowded), np.flatnonzero(crowded)
            rows = _binary(data, begin[few], count[few] + LENGTH - 1)
            yield pa.record_batch(
                [pa.array(anchor[few]), pa.array(ids[few]), pa.array(start[few], pa.int32()), pa.array(count[few], pa.int32()), pa.array(alone[few]), rows, *(pa.nulls(len(few), pa.int64()) for _ in range(2))], names
            )
            if not len(many):
                continue
            # The first window is ``place`` bytes before the anchor, the last one ``place - count + 1``.
            high, low = place[many] // STEP, (place[many] - count[many] + 1) // STEP
            of = np.repeat(many, high - low + 1)
            block = K.ragged(low, high - low + 1)
            at = begin[of] + place[of]
            top, bottom = np.minimum(block * STEP + STEP - 1, place[of]), np.maximum(block * STEP, place[of] - count[of] + 1)
            first, windows = at - top, top - bottom + 1
            rolling = K.Rolling(data)
            key = rolling.spans(at - block * STEP, at - block * STEP + LENGTH - STEP + 1)
            content, more = digests(data, first, first + windows + LENGTH - 1)
            rows = _binary(data, first, windows + LENGTH - 1)
            yield pa.record_batch(
                [
                    pa.array(K.mix(key + block.astype(K.U)).view(np.int64)), pa.array(ids[of]), pa.array(first - offsets[doc[of]], pa.int32()), pa.array(windows, pa.int32()),
                    pa.array(alone[of]), rows, pa.array(content), pa.array(more),
                ],
                names,
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of each window of (row, start, windows, alone, data)."""
    for batch in batches:
        data, offsets = K.as_bytes(batch.column(4))
        start, count = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        row = np.repeat(np.arange(batch.num_rows), count)
        at = K.ragged(offsets[:-1], count)
        a, b = digests(data, at, at + LENGTH)
        place = (at - offsets[row] + start[row]).astype(np.int32)
        rows = pa.array(row)
        yield pa.record_batch([batch.column(0).take(rows), pa.array(place), batch.column(3).take(rows), pa.array(a), pa.array(b)], ["row", "start", "alone", "a", "b"])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def _spans_of(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [merge([(s["start"], s["stop"]) for s in x]) if x else [] for x in column.to_pylist()]


def report(docs: DataFrame) -> DataFrame:
    """Digest of what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, most=BLOCK_BYTES):
                text, cut = data.tobytes(), offsets.tolist()
                gone = _spans_of(part.column(2))
                left = [hashlib.sha256(_kept(text[a:b], g)).hexdigest() for a, b, g in zip(cut, cut[1:], gone, strict=False)]
                columns = [np.diff(offsets), [sum(b - a for a, b in g) for g in gone], [len(g) for g in gone]]
                yield pa.record_batch([part.column(0), *(pa.array(x, pa.int64()) for x in columns), pa.array(left, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    marked = docs.join(removals(docs).hint("merge"), "row", "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` with texts without the repeated passages, all other columns as they were; documents of which
    nothing visible is left go. Spans shrink to whole characters."""

    @F.pandas_udf("string")
    def left(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or own is None or not len(own):
                out.append(text)
                continue
            raw, gone = text.encode(), []
            for a, b in merge([(s["start"], s["stop"]) for s in own]):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                gone.append((a, b))
            out.append(_kept(raw, gone).decode())
        return pd.Series(out, dtype=object)

    row, spans = unused("row", docs.columns), unused("spans", docs.columns)
    rows = numbered(docs, row)
    gone = removals(rows.select(F.col(row).alias("row"), "text")).toDF(row, spans)
    out = rows.join(gone.hint("merge"), row, "left")
    out = out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(left("text", spans)))
    return out.where(F.col(spans).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)
