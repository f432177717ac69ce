"""Operator 3: language identification by word-first backoff.

Words are runs of letters of the lower-cased text. A known word is scored by its log frequency in each
language; for an unseen word the longest character n-grams that are known (4, 3, 2, then 1 characters,
word starts and ends told apart) are scored instead. The language of the highest sum wins, the
alphabetically first of equals; the score is its share of the normalised likelihoods.

The model is fitted on at most about ``SAMPLE`` labelled documents of each language, whole texts, chosen by a hash of
doc_id, and keeps for each language the ``ENTRIES`` most frequent words and as many n-grams of each length. That bounds what is
broadcast by the number of languages and is meant to lie beyond what a sample has: 2,000 documents of usual length have some
70,000 words. A small language is learnt beside large ones.

Null texts and texts without letters are ``und`` with score 0; so is every text if nothing is labelled. Repeated doc_ids are rows
like any others. A text of any length is one unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import LETTER, PerfectHash, classes

SAMPLE, ENTRIES, ORDERS, SMOOTH = 2000, 250_000, (4, 3, 2, 1), 0.5


@dataclass
class Words:
    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray  # of each word's characters
    count: np.ndarray
    starts: np.ndarray  # of characters
    ends: np.ndarray
    hashes: K.Rolling

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``words``, key) of the n-grams of some words; a shorter word has none."""
        many = np.maximum(self.count[words] - n + 1, 0)
        at = K.ragged(self.first[words], many)
        of = np.repeat(np.arange(len(words)), many)
        edge = (at == np.repeat(self.first[words], many)) + 2 * (at + n == np.repeat(self.first[words] + self.count[words], many))
        return of, K.mix(self.hashes.spans(self.starts[at], self.ends[at + n - 1]) + (edge + 4 * n).astype(K.U) * K.U(K.P2))


def find_words(part: pa.RecordBatch) -> tuple[Words, int]:
    data, offsets = K.as_bytes(pc.utf8_lower(part.column(part.schema.get_field_index("text"))))
    n = len(data)
    cls, head = classes(data)
    letter = cls == LETTER
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = letter & edge[:n], letter & edge[1:]
    start[1:] |= letter[1:] & ~letter[:-1]
    end[:-1] |= letter[:-1] & ~letter[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    chars = np.flatnonzero(head & letter)
    heads = np.append(np.flatnonzero(head), n)
    ends = heads[np.searchsorted(heads, chars) + 1] if len(chars) else chars
    first = np.searchsorted(chars, start)
    hashes = K.Rolling(data)
    return Words(K.doc_of(offsets, start), K.span_hashes(K.chunks(data), data, start, end), first, np.searchsorted(chars, end) - first, chars, ends, hashes), len(offsets) - 1


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@dataclass
class Table:
    """Log frequencies of the entries of one order: for entry i, how much languages that have it lie above their ``unseen``."""

    places: PerfectHash
    starts: np.ndarray
    langs: np.ndarray
    above: np.ndarray
    unseen: np.ndarray

    def add(self, total: np.ndarray, doc: np.ndarray, at: np.ndarray, weight: float) -> None:
        """Add the scores of entries (-1: unseen) to their documents' rows."""
        total += np.bincount(doc, minlength=len(total))[:, None] * self.unseen * weight
        doc, at = doc[at >= 0], at[at >= 0]
        many = self.starts[at + 1] - self.starts[at]
        own = K.ragged(self.starts[at], many)
        total += np.bincount(np.repeat(doc, many) * total.shape[1] + self.langs[own], self.above[own] * weight, total.size).reshape(total.shape)


@dataclass
class Model:
    languages: list[str]
    tables: dict[int, Table]  # by order, 0 for words

    def predict(self, part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        words, n = find_words(part)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        total = np.zeros((n, len(self.languages)))
        any_word = np.bincount(words.doc, minlength=n) > 0
        row = self.tables[0].places.get(words.key)
        left = np.flatnonzero(row < 0)
        self.tables[0].add(total, words.doc[row >= 0], row[row >= 0], 1)
        for order in ORDERS:
            if not len(left):
                break
            of, key = words.grams(left, order)
            at = self.tables[order].places.get(key)
            known = np.bincount(of[at >= 0], minlength=len(left)) > 0
            if order == ORDERS[-1]:
                known[:] = True
            use = known[of]
            self.tables[order].add(total, words.doc[left[of[use]]], at[use], 1 / order)
            left = left[~known]
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if a else "und" for a, b in zip(any_word, best, strict=True)], np.where(any_word, share, 0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """From the text and lang of ``labelled`` (rows with a null of either teach nothing)."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    bound = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1 << 40, (sample << 40) // sizes[x]))) for x in names], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 40)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in K.slices(batch):
                words, n = find_words(part)
                own, lang = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                every = np.arange(len(words.key))
                for order in (0, *ORDERS):
                    of, key = (every, words.key) if not order else words.grams(every, order)
                    for k, name in enumerate(own):
                        keys, counts = np.unique(key[lang[words.doc[of]] == k], return_counts=True)
                        yield pa.record_batch(
                            [pa.array([name] * len(keys), pa.string()), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                            ["lang", "order", "key", "n"],
                        )

    counts = chosen.mapInArrow(run, "lang string, order int, key long, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("place", place).where(F.col("place") <= entries).toArrow()
    order, key, n = (top.column(c).to_numpy() for c in ("order", "key", "n"))
    lang = np.searchsorted(np.array(names, object), np.array(top.column("lang").to_pylist(), object)) if top.num_rows else np.zeros(0, np.int64)
    tables = {}
    for k in (0, *ORDERS):
        own = np.flatnonzero(order == k)
        own = own[np.lexsort((lang[own], key[own].view(K.U)))]
        keys, first = np.unique(key[own].view(K.U), return_index=True)
        total = np.bincount(lang[own], n[own], max(1, len(names))) + SMOOTH * (len(keys) + 1)
        unseen = np.log(SMOOTH / total)
        above = np.log((n[own] + SMOOTH) / total[lang[own]]) - unseen[lang[own]]
        tables[k] = Table(PerfectHash(keys, np.arange(len(keys))), np.append(first, len(own)), lang[own], above, unseen)
    return Model(names, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in K.slices(batch):
                names, score = shared.value.predict(part)
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
