"""Operator 8: language-model scoring by a trigram model in Elias-Fano tries.

Texts are taken in blocks of whole documents. A block knows its different words, pairs and triples of
neighbours and how often each occurs in training documents. It sends them to the shards of the model as one
small message each, nested as in a trie: words, under each the words that follow, under each of these pairs
the third words. A shard adds the counts of its messages up and builds three levels of Elias-Fano sequences with
monotone pointers, memory-mapped, that hold what occurs in training and nothing else. Each message is then
looked up by successor search within contexts, and answered with counts and quantised probabilities; strangers
(all that only held-out documents have) are not found. The block adds the logarithms of its documents up:

    P(c | a b) = (1 - l(n(a b))) n(a b c) / n(a b) + l(n(a b)) P(c | b),   likewise P(c | b) over P(c),
    P(c) = (n(c) + 1) / (N + V + 1),   l(n) = n ** -FALL / 2,   l(0) = 1

Counts are exact and over all documents; no pair or triple is pruned. Words are told apart by 80 bits of XXH3 between
blocks (bytes within one), second words by 32 bits and third words by 24 within their contexts.

Contexts that are very frequent (more than a quarter of a shard's share of all tokens; four for each shard at most, found
in one document of ``EVERY``, which only decides the layout) are dealt over SPREAD places by their successors, and their
totals are counted ahead. Messages are as many as the segments of any shuffle from blocks to shards.

Null and empty texts are one end token. Repeated doc_ids are scored row by row; rows without a doc_id stay so and are learnt from. A text of any length is in one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import kernels as K
from .tables import materialize, partitions
from .trie import EliasFano, Level, Store, quantise, restore

MOD, HELD, SPREAD, EVERY, BLOCK_BYTES = 7, 2, 64, 16, 8 << 20
#: Falls of the backoff weight with the count of a word and of a pair as a context.
FALL = (0.3, 0.8)


def zstd(data: bytes | np.ndarray) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def unzstd(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


def weight(n: np.ndarray, fall: float) -> np.ndarray:
    """Share of a context's probability that goes to the shorter context."""
    return np.where(n > 0, 0.5 * np.maximum(n, 1).astype(np.float64) ** -fall, 1.0)


def share(n: np.ndarray, total: np.ndarray, fall: float) -> np.ndarray:
    """Quantised own part of n out of a context's total; 0 where n is 0."""
    part = (1 - weight(total, fall)) * n / np.maximum(total, 1)
    return np.where(n > 0, quantise(np.log10(np.where(n > 0, part, 1))), 0).astype(np.uint8)


def pack(hashes: list[tuple[np.ndarray, int]], small: list[np.ndarray]) -> bytes:
    """Arrays on end: ``hashes`` in a given number of bytes each, ``small`` numbers in the least width, compressed."""
    head, raw, rest = [len(hashes), len(small)], [], []
    for a, width in hashes:
        head += [width, len(a)]
        raw.append(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    for a in small:
        top = int(a.max(initial=0))
        width = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
        head += [width, len(a)]
        rest.append(a.astype(f"<u{width}").tobytes())
    packed = zstd(b"".join(rest))
    return b"".join([len(head).to_bytes(2, "little"), np.array(head, "<u4").tobytes(), *raw, packed])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:2], "little")
    head, at, out = np.frombuffer(blob, "<u4", n, 2).tolist(), 2 + 4 * n, []
    sizes = [(head[i], head[i + 1]) for i in range(2, n, 2)]
    for width, count in sizes[: head[0]]:
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, count * width, at).reshape(-1, width)
        out.append(wide.view("<u8").ravel())
        at += count * width
    rest = unzstd(blob[at:], sum(w * c for w, c in sizes[head[0] :]))
    at = 0
    for width, count in sizes[head[0] :]:
        out.append(np.frombuffer(rest, f"<u{width}", count, at))
        at += count * width
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and 16 more of each word's XXH3, and of nothing (END) as the last."""
    view = memoryview(np.ascontiguousarray(data))
    found = [xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    wide = np.frombuffer(b"".join([*found, xxh3_128_digest(b"")]), ">u8").reshape(-1, 2)
    return wide[:, 0].astype(K.U), (wide[:, 1] & K.U(0xFFFF)).astype(np.int64)


class Sequence:
    """Values of words with one for the end after each document's last, and what stands before each."""

    def __init__(self, start: np.ndarray, offsets: np.ndarray, values: np.ndarray, end: int):
        self.sizes = np.diff(np.searchsorted(start, offsets, "left")) + 1
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.full(int(self.sizes.sum()), end, np.int64)
        self.tokens[np.arange(len(start)) + np.repeat(np.arange(len(self.sizes)), self.sizes - 1)] = values
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.begin] = end


class Tokens(Sequence):
    """The words of a block, sorted by hash, and its tokens as places in them; END is the hash of nothing."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end = K.words(data, offsets)
        group, first, spans = K.identify(data, start, end)
        hashes, tags = digests(data, start[first], end[first])
        order = np.lexsort((tags, hashes))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.tags, self.spans, self.end = hashes[order], tags[order], np.append(spans, K.U(0))[order], int(rank[-1])
        super().__init__(start, offsets, rank[group], self.end)


def training(ids: np.ndarray) -> np.ndarray:
    """Whether each of ``kernels.id_column`` is learnt from."""
    return (K.crc_mod(ids[:, 0], MOD) != HELD) | (ids[:, 1] > 0)


# Very frequent contexts.


class Frequent:
    """Very frequent words (hash, tag) and pairs of such words (places in them, as a * words + b), with exact training counts."""

    def __init__(self, words: list[tuple[int, int, int]], pairs: list[tuple[int, int]]):
        wide = sorted((w & (1 << 64) - 1, t, x & (1 << 64) - 1) for w, t, x in words)
        self.words, self.tags, self.spans = np.array([x[0] for x in wide], K.U), np.array([x[1] for x in wide], np.int64), np.sort(np.array([x[2] for x in wide], K.U))
        at = {int(w): i for i, w in enumerate(self.words)}
        self.pairs = np.array(sorted({at[a & (1 << 64) - 1] * len(at) + at[b & (1 << 64) - 1] for a, b in pairs if a & (1 << 64) - 1 in at and b & (1 << 64) - 1 in at}), np.int64)
        self.counts, self.pair_counts, self.total = np.zeros(len(self.words), np.int64), np.zeros(len(self.pairs), np.int64), 0

    def of_words(self, words: np.ndarray, tags: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where((self.words[at] == words) & (self.tags[at] == tags), at, -1)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """From places of words, -1 where there is none."""
        if not len(self.pairs):
            return np.full(len(a), -1, np.int64)
        key = np.where((a >= 0) & (b >= 0), a * len(self.words) + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)


TALLY = "kind int, a long, b long, c long, n long"


def _tally(kind: int, n: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    signed = [pa.array(np.ascontiguousarray(x).astype(K.U).view(np.int64)) for x in (*keys, *[np.zeros(len(n), K.U)] * (3 - len(keys)))]
    return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), *signed, pa.array(n.astype(np.int64))], ["kind", "a", "b", "c", "n"])


def find_frequent(docs: DataFrame, shards: int) -> Frequent:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.gathered(batches, most=BLOCK_BYTES):
            for _, data, offsets in K.slices(batch, most=BLOCK_BYTES):
                t = Tokens(K.lower_ascii(data), offsets)
                counts = np.bincount(t.tokens, minlength=len(t.words))
                often = counts * 4 * shards > len(t.tokens)
                own = np.flatnonzero(often)
                yield _tally(0, np.array([len(t.tokens)]))
                yield _tally(1, counts[own], t.words[own], t.tags[own], t.spans[own])
                both = np.flatnonzero(often[t.before] & often[t.tokens])
                pair, n = np.unique(t.before[both] * len(t.words) + t.tokens[both], return_counts=True)
                pair, n = pair[n * 4 * shards > len(t.tokens)], n[n * 4 * shards > len(t.tokens)]
                yield _tally(2, n, t.words[pair // len(t.words)], t.words[pair % len(t.words)])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(EVERY)) == 0)
    sums = some.mapInArrow(local, TALLY).groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "lm-frequent")
    total = sums.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    got = sums.where(f"kind > 0 and n * {4 * shards} > {total}").collect()
    out = Frequent([(r.a, r.b, r.c) for r in got if r.kind == 1], [(r.a, r.b) for r in got if r.kind == 2])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, whole = np.zeros(len(out.words), np.int64), np.zeros(len(out.pairs), np.int64), 0
        for batch in K.gathered(batches, most=BLOCK_BYTES):
            for part, data, offsets in K.slices(batch, most=BLOCK_BYTES):
                data = K.lower_ascii(data)
                start, end = K.words(data, offsets)
                group, first, spans = K.identify(data, start, end)
                at = np.full(len(first) + 1, -1, np.int64)
                own = np.append(np.flatnonzero(np.isin(spans, out.spans)), len(first))  # only these can be, and END
                at[own] = out.of_words(*digests(data, start[first[own[:-1]]], end[first[own[:-1]]]))
                t = Sequence(start, offsets, at[group], at[-1])
                train = np.repeat(training(K.id_column(part, "doc_id")), t.sizes)
                whole += int(train.sum())
                words += np.bincount(t.tokens[train & (t.tokens >= 0)], minlength=len(words))
                pair = out.of_pairs(t.before, t.tokens)
                pairs += np.bincount(pair[train & (pair >= 0)], minlength=len(pairs))
        yield _tally(0, np.array([whole]))
        for kind, n in ((1, words), (2, pairs)):
            yield _tally(kind, n, np.arange(len(n)))

    for r in docs.mapInArrow(exact, TALLY).groupBy("kind", "a").agg(F.sum("n").alias("n")).collect():
        if r.kind == 0:
            out.total = r.n
        else:
            (out.counts if r.kind == 1 else out.pair_counts)[r.a] = r.n
    return out


# Blocks and their messages.


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> K.U(32)) * K.U(shards) >> K.U(32)).astype(np.int64)


class Block(Tokens):
    """Pairs (a, b) as entries under their first word, triples as children of their entry, and where they go.

    An entry is cold (its first word is the shard's own) or warm (its first word is very frequent). Children of a very frequent
    pair go by their own last word ("loose"). Entries stand in order of (a, b), children in order of (entry, c)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, hot: Frequent, shards: int):
        super().__init__(K.lower_ascii(data), offsets)
        width = len(self.words)
        self.train = training(ids)
        train = np.repeat(self.train, self.sizes)
        entries, entry = np.unique(np.append(self.before * width + self.tokens, self.end * width + self.end), return_inverse=True)
        self.entry = entry[:-1]
        self.context = np.empty_like(self.entry)
        self.context[1:] = self.entry[:-1]
        self.context[self.begin] = entry[-1]
        children, self.child = np.unique(self.context * width + self.tokens, return_inverse=True)
        self.n2, self.n3 = np.bincount(self.entry[train], minlength=len(entries)), np.bincount(self.child[train], minlength=len(children))
        self.a, b = entries // width, entries % width
        parent, c = children // width, children % width
        self.second, self.third = self.words[b] & K.U(0xFFFFFFFF), self.words[c] & K.U(0xFFFFFFFF)
        self.hot_word = hot.of_words(self.words, self.tags)
        self.hot_entry = hot.of_pairs(self.hot_word[self.a], self.hot_word[b])
        many = np.bincount(parent, minlength=len(entries))
        first = np.cumsum(many) - many
        self.many = np.where(self.hot_entry >= 0, 0, many)
        salt = lambda key, by: _shard(K.mix(key + (by * K.U(SPREAD) >> K.U(32)) + K.U(1)), shards)
        word_shard = _shard(self.words, shards)
        is_warm = self.hot_word[self.a] >= 0
        cold, warm = np.flatnonzero(~is_warm), np.flatnonzero(is_warm)
        place = salt(self.words[self.a[warm]], self.second[warm])
        warm, place = warm[np.argsort(place, kind="stable")], np.sort(place)
        loose = np.flatnonzero(self.hot_entry[parent] >= 0)
        of = self.hot_entry[parent[loose]]
        loose_place = salt(K.mix(of.astype(K.U) + K.U(K.P1)), self.third[loose])
        order = np.argsort(loose_place, kind="stable")
        self.loose, self.loose_of, loose_place = loose[order], of[order], loose_place[order]
        edges = np.arange(shards + 1)
        self.word_cut = np.searchsorted(word_shard, edges)
        self.per_word = np.bincount(self.a[cold], minlength=width)
        sides = []
        for own, at in ((cold, word_shard[self.a[cold]]), (warm, place)):
            cut = np.searchsorted(at, edges)
            sides.append((own, cut, K.ragged(first[own], self.many[own]), np.concatenate([[0], np.cumsum(self.many[own])])[cut]))
        self.cold, self.warm = sides
        self.loose_cut = np.searchsorted(loose_place, edges)

    def message(self, s: int) -> bytes:
        w = slice(self.word_cut[s], self.word_cut[s + 1])
        hashes, small = [(self.words[w], 8), (self.tags[w], 2)], [self.per_word[w]]
        for kind, (own, cut, kids, kid_cut) in enumerate((self.cold, self.warm)):
            e, c = own[cut[s] : cut[s + 1]], kids[kid_cut[s] : kid_cut[s + 1]]
            hashes += [(self.second[e], 4), (self.third[c], 3)]
            small += [self.n2[e], self.many[e], self.n3[c]] + ([self.hot_word[self.a[e]]] if kind else [])
        x = slice(self.loose_cut[s], self.loose_cut[s + 1])
        return pack([*hashes, (self.third[self.loose[x]], 4)], [*small, self.loose_of[x], self.n3[self.loose[x]]])


class Message:
    """What a message says; ``a`` is not known yet for cold entries (``per_word`` of each word)."""

    def __init__(self, blob: bytes):
        got = unpack(blob)
        self.words, self.tags = got[0], got[1].astype(np.int64)
        self.second, self.third, self.loose = (got[2], got[4]), (got[3], got[5]), got[6]
        small = [x.astype(np.int64) for x in got[7:]]
        self.per_word = small[0]
        self.n2, self.many, self.n3 = (small[1], small[4]), (small[2], small[5]), (small[3], small[6])
        self.hot_word, self.loose_of, self.loose_n = small[7], small[8], small[9]


# Shards.


class Shard:
    """A shard's levels: words, their successors and those of pairs, in memory-mapped files. Very frequent words are contexts
    0, 1, ...; the shard's own words follow. Only what occurs in training has a place."""

    def __init__(self, messages: list[Message], hot: Frequent):
        self.store = Store()
        keep, n_hot = self.store.keep, len(hot.words)
        cat = lambda arrays: np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)
        words, back = np.unique(np.concatenate([*(m.words for m in messages), np.zeros(0, K.U)]), return_inverse=True)
        key = back << 16 | cat(m.tags for m in messages)
        key, back = np.unique(key, return_inverse=True)
        cut = np.concatenate([[0], np.cumsum([len(m.words) for m in messages])]).astype(np.int64)
        context, second, n2, many, third, n3 = [], [], [], [], [], []
        for i, m in enumerate(messages):
            context += [np.repeat(back[cut[i] : cut[i + 1]] + n_hot, m.per_word), m.hot_word]
            for k in range(2):
                second.append(m.second[k])
                third.append(m.third[k])
                n2.append(m.n2[k])
                many.append(m.many[k])
                n3.append(m.n3[k])
        pairs, at = np.unique(cat(context).astype(K.U) << K.U(32) | np.concatenate([*second, np.zeros(0, K.U)]), return_inverse=True)
        count2 = np.bincount(at, cat(n2), len(pairs)).astype(np.int64)
        triples, own = np.unique(np.repeat(at, cat(many)).astype(K.U) << K.U(24) | np.concatenate([*third, np.zeros(0, K.U)]), return_inverse=True)
        count3 = np.bincount(own, cat(n3), len(triples)).astype(np.int64)
        triples, count3 = triples[count3 > 0], count3[count3 > 0]
        parent = (triples >> K.U(24)).astype(np.int64)
        total3 = np.bincount(parent, count3, len(pairs)).astype(np.int64)
        kept = np.flatnonzero((count2 > 0) | (total3 > 0))
        number = np.cumsum((count2 > 0) | (total3 > 0)) - 1
        pairs, count2, total3 = pairs[kept], count2[kept], total3[kept]
        parent = number[parent]
        context = (pairs >> K.U(32)).astype(np.int64)
        # Words without a pair in training lose their places.
        real = np.unique(context[context >= n_hot]) - n_hot
        key, context = key[real], np.where(context >= n_hot, n_hot + np.searchsorted(real, context - n_hot), context)
        self.n_hot, self.contexts = n_hot, n_hot + len(key)
        of = np.unique(key >> 16)
        self.words = EliasFano(words[of], keep)
        self.tags = Level(len(of), np.searchsorted(of, key >> 16).astype(K.U) << K.U(16) | (key & 0xFFFF).astype(K.U), 16, keep)
        total = np.bincount(context, count2, self.contexts).astype(np.int64)
        self.distinct = int(np.count_nonzero(total[n_hot:]))
        self.totals = keep(total)
        self.level2 = Level(self.contexts, context.astype(K.U) << K.U(32) | pairs & K.U(0xFFFFFFFF), 32, keep)
        self.level3 = Level(len(pairs), parent.astype(K.U) << K.U(24) | triples & K.U(0xFFFFFF), 24, keep)
        # Under very frequent words counts stand as they are, since their totals are not this shard's.
        warm = int(np.searchsorted(context, n_hot))
        self.code2 = keep(np.concatenate([count2[:warm], share(count2[warm:], total[context[warm:]], FALL[0])]).astype(np.int64) if warm else share(count2, total[context], FALL[0]))
        self.back3 = keep(quantise(np.log10(weight(total3, FALL[1]))))
        self.code3 = keep(share(count3, total3[parent], FALL[1]))
        loose, at = np.unique(cat(m.loose_of for m in messages).astype(K.U) << K.U(32) | np.concatenate([*(m.loose for m in messages), np.zeros(0, K.U)]), return_inverse=True)
        n = np.bincount(at, cat(m.loose_n for m in messages), len(loose)).astype(np.int64)
        self.loose, self.loose_n = Level(len(hot.pairs), loose[n > 0], 32, keep), keep(n[n > 0])

    def word(self, words: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Contexts of the shard's own words, -1 for strangers."""
        at = self.words.successor(words)
        inside = np.flatnonzero(at < self.words.n)
        same = inside[self.words.get(at[inside]) == words[inside]]
        out = np.full(len(words), -1, np.int64)
        out[same] = at[same]
        out = self.tags.find(out, tags)
        return np.where(out >= 0, out + self.n_hot, -1)

    def answer(self, m: Message) -> bytes:
        pick = lambda values, at, none: np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else none, none)
        word = self.word(m.words, m.tags)
        out = [np.array([self.distinct]), pick(self.totals, word, 0)]
        for k, context in enumerate((np.repeat(word, m.per_word), m.hot_word)):
            at = self.level2.find(context, m.second[k])
            kids = self.level3.find(np.repeat(at, m.many[k]), m.third[k])
            out += [pick(self.code2, at, 0), pick(self.back3, at, 255)[m.many[k] > 0], pick(self.code3, kids, 0)]
        return pack([], [*out, pick(self.loose_n, self.loose.find(m.loose_of, m.loose), 0)])


def _answers(table: pa.Table, hot: Frequent) -> pa.Table:
    """A shard: all messages to it in, an answer to each out."""
    blobs = table.column("message").to_pylist()
    messages = [Message(x) for x in blobs]
    shard = Shard(messages, hot)
    out = [shard.answer(x) for x in messages]
    shard.store.close()
    return pa.table([table.column("block"), table.column("shard"), pa.array(out, pa.binary())], ["block", "shard", "answer"])


# Scores.

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(left: pa.Table, right: pa.Table, hot: Frequent, shards: int) -> pa.Table:
    row = left.to_pylist()[0]
    ids, offsets = np.frombuffer(row["ids"], "<i8").reshape(-1, 2), np.frombuffer(row["offsets"], "<i8")
    data = np.frombuffer(unzstd(row["text"], int(offsets[-1])), np.uint8)
    b = Block(data, offsets, ids, hot, shards)
    if any(x != row["crc"] for x in right.column("crc").to_pylist()):
        raise RuntimeError("the rows of docs came in another order when they were read again; pass stable=False")
    got = [unpack(x) for _, x in sorted(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True))]
    column = lambda k: np.concatenate([x[k] for x in got])
    distinct, count = sum(int(x[0][0]) for x in got) + int(np.count_nonzero(hot.counts)), column(1).astype(np.int64)
    own = np.flatnonzero(b.hot_word >= 0)
    count[own] = hot.counts[b.hot_word[own]]
    code2, back3, code3 = np.zeros(len(b.n2), np.uint8), np.full(len(b.n2), 255, np.uint8), np.zeros(len(b.n3), np.uint8)
    for k, (entries, _, kids, _) in enumerate((b.cold, b.warm)):
        code2[entries] = share(column(5).astype(np.int64), count[b.a[entries]], FALL[0]) if k else column(2)
        back3[entries[b.many[entries] > 0]] = column(3 + 3 * k)
        code3[kids] = column(4 + 3 * k)
    loose = np.flatnonzero(b.hot_entry >= 0)
    totals = hot.pair_counts.copy()
    ends = hot.of_words(b.words[b.end : b.end + 1], b.tags[b.end : b.end + 1])
    if (both := int(hot.of_pairs(ends, ends)[0])) >= 0:
        totals[both] = hot.counts[ends[0]]  # every document begins there
    back3[loose] = quantise(np.log10(weight(totals[b.hot_entry[loose]], FALL[1])))
    code3[b.loose] = share(column(8).astype(np.int64), totals[b.loose_of], FALL[1])
    single = (count + 1) / (hot.total + distinct + 1)
    one = single[b.tokens]
    two = restore(code2)[b.entry] + weight(count, FALL[0])[b.before] * one
    three = restore(code3)[b.child] + restore(back3)[b.context] * two
    columns = [
        pa.array(ids[:, 0], mask=ids[:, 1] > 0),
        pa.array(~b.train),
        pa.array(b.sizes),
        pa.array(np.add.reduceat((count > 0)[b.tokens].astype(np.int64), b.begin)),
        pa.array(np.full(len(ids), hot.total)),
        pa.array(np.add.reduceat(np.log10(single)[b.tokens], b.begin)),
        pa.array(np.add.reduceat(np.log10(three), b.begin)),
    ]
    return pa.table(columns, [c.split()[0] for c in SCORES.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(block, doc_ids, bytes, offsets, checksum) of a partition's blocks."""
    block = TaskContext.get().partitionId() << 32
    for batch in K.gathered(batches, most=BLOCK_BYTES):
        for part, data, offsets in K.slices(batch, most=BLOCK_BYTES):
            ids = K.id_column(part, "doc_id")
            yield block, ids, data, offsets, zlib.crc32(data, zlib.crc32(offsets.tobytes(), zlib.crc32(ids.astype("<i8").tobytes())))
            block += 1


def score(docs: DataFrame, stable: bool = False) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score (the model).

    ``docs`` is read again for the scores; a plan that need not give its rows in one order each time is written out first,
    unless ``stable`` says that it does (a table in files)."""
    spark = docs.sparkSession
    shards = partitions(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    if not stable:
        docs = materialize(docs, "lm-documents")
    hot = find_frequent(docs, shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, data, offsets, crc in _slices(batches):
            own = Block(data, offsets, ids, hot, shards)
            for lo in range(0, shards, 64):
                to = np.arange(lo, min(shards, lo + 64))
                yield pa.record_batch([pa.array(to), pa.array(np.full(len(to), block)), pa.array(np.full(len(to), crc)), pa.array([own.message(s) for s in to.tolist()], pa.binary())], ["shard", "block", "crc", "message"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, data, offsets, crc in _slices(batches):
            row = [ids.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), zstd(K.lower_ascii(data))]
            yield pa.record_batch([pa.array([block]), pa.array([crc]), *(pa.array([x], pa.binary()) for x in row)], ["block", "crc", "ids", "offsets", "text"])

    sent = docs.mapInArrow(send, "shard long, block long, crc long, message binary")

    def reply(table: pa.Table) -> pa.Table:
        return _answers(table, hot).append_column("crc", table.column("crc"))

    answers = sent.groupBy("shard").applyInArrow(reply, "block long, shard long, answer binary, crc long")
    blocks = docs.mapInArrow(texts, "block long, crc long, ids binary, offsets binary, text binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, hot, shards), SCORES)
