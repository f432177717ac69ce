"""Operator 9: quality rules with line labels by a linear-chain conditional random field.

Each line with a word becomes a bit set of features (symbols, capitals, separators, repeats, length,
punctuation). A two-state chain with trained weights labels the lines content or boilerplate by Viterbi
decoding, and the share of word bytes in content lines decides. Fixed rules come first.

The chain is trained by its exact likelihood on labelled documents, ``SAMPLE`` of them at most (chosen by
a hash of doc_id): the lines of a document of quality 1 are content, those of quality 0 boilerplate.
Without labels of both kinds it has ``PRIOR``, weights of the same features set by hand.

Null and empty texts have no words and fail. Repeated doc_ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE, SHARE = 2000, 0.5
FEATURES = [
    "bias", "symbols>1%", "symbols>5%", "capitals>25%", "capitals>60%", "exclamations>3%", "bars>2%", "digits>20%",
    "same word again>20%", "repeated windows>30%", "line seen before", "words<3", "words>=8", "ends in a stop", "mean word>14 bytes",
]


@dataclass
class Lines:
    """Counts of each document of a slice, and its lines with a word: document, features, word bytes."""

    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    repeats: np.ndarray
    dups: np.ndarray
    doc: np.ndarray
    bits: np.ndarray
    ink: np.ndarray


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def analyse(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(offsets) - 1
    start, end = K.words(data, offsets)
    doc = K.doc_of(offsets, start)
    word, _, _ = K.identify(data, start, end)
    size = end - start

    def upto(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])

    first = np.searchsorted(start, offsets, "left")
    head = upto((data & 0xC0) != 0x80)
    chars = np.zeros(n, np.int64)
    np.add.at(chars, doc, head[end] - head[start])
    is_symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    symbol = upto(is_symbol)
    # Words in windows of three that the document has twice or more.
    repeat = np.zeros(len(word), bool)
    if len(word) > 2:
        inside, many = np.flatnonzero(doc[2:] == doc[:-2]), int(word.max()) + 1
        number = lambda key: np.unique(key, return_inverse=True)[1]
        pair = number(doc[inside] * many + word[inside])
        pair = number(pair * many + word[inside + 1])
        twice = inside[_again(pair * many + word[inside + 2])[0]]
        for k in range(3):
            repeat[twice + k] = True
    # Lines with a word, by the line feeds before their words.
    feeds = np.flatnonzero(data == 10)
    of_word = np.searchsorted(feeds, start)
    new = np.ones(len(word), bool)
    new[1:] = (of_word[1:] != of_word[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(word)))
    line_doc, line = doc[at], of_word[at]
    begin = np.maximum(offsets[line_doc], np.append(feeds, 0)[line - 1] + 1 if len(feeds) else 0)
    begin = np.where(line > 0, begin, offsets[line_doc])
    until = np.minimum(offsets[line_doc + 1], np.append(feeds, len(data))[line])
    _, seen = _again(K.identify(data, begin, until)[0] * n + line_doc)

    def per_line(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)

    ink = per_line(size)
    total = np.maximum(ink, 1)
    capital, mark, bar, digit = (upto(x) for x in ((data >= 65) & (data <= 90), data == 33, data == 124, (data >= 48) & (data <= 57)))
    inside = lambda sums: sums[until] - sums[begin]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & ~new[1:]
    last = end[at + count - 1] - 1 if len(at) else np.zeros(0, np.int64)
    flags = [
        np.ones(len(at), bool),
        100 * inside(symbol) > total, 20 * inside(symbol) > total,
        4 * inside(capital) > total, 10 * inside(capital) > 6 * total,
        100 * inside(mark) > 3 * total, 50 * inside(bar) > total, 5 * inside(digit) > total,
        5 * per_line(same) > count, 10 * per_line(repeat) > 3 * count,
        seen, count < 3, count >= 8,
        np.isin(data[last], np.frombuffer(b".!?:", np.uint8)) if len(at) else np.zeros(0, bool),
        ink > 14 * count,
    ]
    bits = np.zeros(len(at), np.int64)
    for k, flag in enumerate(flags):
        bits |= flag.astype(np.int64) << k
    return Lines(
        np.diff(first), chars, symbol[offsets[1:]] - symbol[offsets[:-1]],
        np.bincount(doc[repeat], minlength=n), np.bincount(line_doc[seen], minlength=n), line_doc, bits, ink,
    )


@dataclass
class Chain:
    """Weights of a two-state chain: of features for boilerplate (content has zero), of steps between states, of the first."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def scores(self, bits: np.ndarray) -> np.ndarray:
        on = (bits[:, None] >> np.arange(len(self.weights))) & 1
        return on @ self.weights


#: Weights by hand, in the order of FEATURES.
PRIOR = Chain(np.array([-3.0, 2, 3, 2, 3, 2, 3, 1, 3, 3, 1, 0.5, -1, -1, 0.5]), np.array([[1.0, 0], [0, 1.0]]), np.zeros(2))


def _turns(doc: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For t = 0, 1, ...: the lines that are number t of their documents (documents' lines stand on end)."""
    if not len(doc):
        return
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(begin, len(doc)))
    by_length = np.argsort(-count, kind="stable")
    begin, count = begin[by_length], count[by_length]
    for t in range(int(count[0])):
        yield begin[: int(np.searchsorted(-count, -t, "left"))] + t, t


def viterbi(chain: Chain, doc: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Best label of each line, 1 for boilerplate; ties go to content."""
    score = chain.scores(bits)
    best, back = np.zeros((len(doc), 2)), np.zeros((len(doc), 2), np.int8)
    turns = list(_turns(doc))
    for at, t in turns:
        if not t:
            best[at] = chain.first
        else:
            ways = best[at - 1][:, :, None] + chain.steps
            back[at] = ways.argmax(1)
            best[at] = ways.max(1)
        best[at, 1] += score[at]
    label = np.zeros(len(doc), np.int8)
    ends = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    for at, _ in reversed(turns):
        final = ends[at]
        label[at[final]] = best[at[final]].argmax(1)
        label[at[~final]] = back[at[~final] + 1, label[at[~final] + 1]]
    return label


def train(doc: np.ndarray, bits: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Chain:
    """Ascend the exact conditional likelihood (forward-backward) by Adam from zero weights."""
    n, size = len(doc), len(FEATURES)
    on = ((bits[:, None] >> np.arange(size)) & 1).astype(np.float64)
    turns, docs = list(_turns(doc)), len(np.unique(doc))
    follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    w = np.zeros(size + 6)
    target = np.concatenate([on.T @ label, np.bincount(label[follows - 1] * 2 + label[follows], minlength=4), np.bincount(label[heads], minlength=2)])
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        steps, first = w[size : size + 4].reshape(2, 2), w[size + 4 :]
        local = np.stack([np.zeros(n), on @ w[:size]], 1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for at, t in turns:
            ahead[at] = local[at] + (first if not t else np.logaddexp.reduce(ahead[at - 1][:, :, None] + steps, axis=1))
        for at, t in reversed(turns):
            if t:
                behind[at - 1] = np.logaddexp.reduce(steps[None] + (local[at] + behind[at])[:, None, :], axis=2)
        whole = np.logaddexp(*(ahead + behind).T)
        p = np.exp(ahead + behind - whole[:, None])
        pair = np.exp(ahead[follows - 1][:, :, None] + steps + (local[follows] + behind[follows])[:, None, :] - whole[follows][:, None, None])
        gradient = (target - np.concatenate([on.T @ p[:, 1], pair.sum(0).ravel(), p[heads].sum(0)])) / docs - decay * w
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w = w + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Chain(w[:size], w[size : size + 4].reshape(2, 2), w[size + 4 :])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Train on at most ``sample`` labelled documents, of rows that share a doc_id on the least text; PRIOR where one kind has none."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # However many rows have a chosen id, one goes on: tasks keep the least text each before the shuffle.
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                got = analyse(data, offsets)
                bounds = np.searchsorted(got.doc, np.arange(len(offsets)))
                blobs = [got.bits[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(blobs, pa.binary())], ["doc_id", "quality", "bits"])

    got = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, bits binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "quality", "bits")), strict=True))
    lines = [np.frombuffer(x, "<i4").astype(np.int64) for _, _, x in rows]
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    label = np.repeat(np.array([1 - q for _, q, _ in rows], np.int64), [len(x) for x in lines])
    if not len(doc) or label.min() == label.max():
        return PRIOR
    return train(doc, np.concatenate(lines), label)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """doc_id with the counts of the fixed rules, the content share and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                got, n = analyse(data, offsets), len(offsets) - 1
                label = viterbi(chain, got.doc, got.bits)
                ink = np.bincount(got.doc, got.ink, minlength=n)
                content = np.bincount(got.doc, got.ink * (label == 0), minlength=n)
                part_of = np.divide(content, ink, out=np.zeros(n), where=ink > 0)
                failed = (got.words < 50) | (100 * got.repeats > 50 * got.words)
                values = [got.words, got.chars, got.symbols, got.dups, got.repeats]
                yield pa.record_batch(
                    [part.column(0), *(pa.array(x.astype(np.int64)) for x in values), pa.array(failed), pa.array(part_of), pa.array(~failed & (part_of >= share))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {COLUMNS}")


def keep(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns as they were; no join."""
    names = docs.columns
    index = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(pa.record_batch(batch.columns, [f"c{i}" for i in range(batch.num_columns)]), f"c{index}"):
                got, n = analyse(data, offsets), len(offsets) - 1
                label = viterbi(chain, got.doc, got.bits)
                ink, content = np.bincount(got.doc, got.ink, minlength=n), np.bincount(got.doc, got.ink * (label == 0), minlength=n)
                good = (got.words >= 50) & (100 * got.repeats <= 50 * got.words) & (content >= share * ink)
                yield pa.record_batch(part.filter(pa.array(good)).columns, names)

    return docs.mapInArrow(run, docs.schema)
