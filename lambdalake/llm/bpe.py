"""Operator 1: byte-level BPE encoding and decoding.

Two tiers. Pre-tokens that are vocabulary entries are resolved by a minimal perfect hash (hash and
displace) probed with whole arrays; each other pre-token is merged by a heap over its linked bytes.
Pre-tokens are found on the byte array from character classes and are merged once per distinct form of a
slice. Heaps of short pre-tokens are complete trees in the rows of one array, popped and sifted together; long ones
use heapq. Hashes only find candidates: forms and entries are compared byte by byte.

Null and empty texts have no tokens. Repeated rows give repeated results. Text of any length is one unit.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernels as K

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Forms are merged once in each slice, so larger ones repeat less work.
SLICE_BYTES = 4 << 20
#: Rust's \s, that is the property White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_class_of: dict[int, int] = {}
_letter, _number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def char_class(cp: int) -> int:
    if (got := _class_of.get(cp)) is None:
        c = chr(cp)
        got = _class_of[cp] = SPACE if cp in WHITE else LETTER if _letter.match(c) else NUMBER if _number.match(c) else OTHER
    return got


ASCII = np.array([char_class(i) for i in range(128)] + [OTHER] * 128, np.uint8)


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte's character, and whether the byte starts a character."""
    cls, head = ASCII[data], (data & 0xC0) != 0x80
    if len(lead := np.flatnonzero(data >= 0xC0)):
        b = data[lead].astype(np.int64)
        n = 2 + (b >= 0xE0) + (b >= 0xF0)
        cp = np.where(n == 2, b & 0x1F, np.where(n == 3, b & 0x0F, b & 0x07))
        for k in (1, 2, 3):
            more = n > k
            cp[more] = cp[more] << 6 | data[lead[more] + k] & 0x3F
        known, back = np.unique(cp, return_inverse=True)
        of = np.array([char_class(int(c)) for c in known], np.uint8)[back]
        cls[lead] = of
        for k in (1, 2, 3):
            cls[lead[n > k] + k] = of[n > k]
    return cls, head


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens, by the published split pattern of this vocabulary."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls, head = classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    start = change | first[:n]
    space = cls == SPACE
    blank = data == 32
    # A blank before a visible character begins that character's token.
    joined = np.flatnonzero(~space[1:] & blank[:-1] & ~first[1:n]) + 1
    start[joined] = False
    # The last character of a run of white space stands alone when something visible follows.
    follow = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    while len(back := np.flatnonzero(~head[follow])):
        follow[back] -= 1
    start[follow] = True
    # Contractions, where the apostrophe begins a token.
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[quote + 1 < n]
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = pad[quote + 1], pad[quote + 2]
        inside = ~first[quote + 1]
        one = inside & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inside & ~first[np.minimum(quote + 2, n)] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        after = after[after < n]
        start[after] = True
        # Letters or blanks after it are handled by the rules above; a blank start is already set there.
    return np.flatnonzero(start)


class PerfectHash:
    """Minimal perfect hash over 64-bit keys by hash and displace; a stored key tells members from strangers.

    Buckets of one size are displaced together, largest first; buckets of one key take the slots left over.
    """

    DIRECT = K.U(1 << 63)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        n = len(keys)
        assert len(np.unique(keys)) == n, "two entries share a hash"
        self.n, self.buckets = max(1, n), max(1, n // 3)
        self.shift = np.zeros(self.buckets, K.U)
        bucket = (keys % K.U(self.buckets)).astype(np.int64)
        keys_by_bucket = keys[np.argsort(bucket, kind="stable")]
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        free, claim = np.ones(self.n, bool), np.zeros(self.n, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            left, d = np.flatnonzero(sizes == size), 0
            while len(left):
                at = self._at(keys_by_bucket[first[left][:, None] + np.arange(size)], np.full((len(left), 1), d, K.U))
                claim[at[::-1]] = np.arange(len(left))[::-1, None]
                inside = np.sort(at, axis=1)
                won = free[at].all(1) & (claim[at] == np.arange(len(left))[:, None]).all(1) & (inside[:, 1:] != inside[:, :-1]).all(1)
                free[at[won]] = False
                self.shift[left[won]] = d
                left, d = left[~won], d + 1
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = np.flatnonzero(free)[: len(single)].astype(K.U) | self.DIRECT
        self.keys, self.values = np.zeros(self.n, K.U), np.full(self.n, -1, np.int64)
        at = self.slot(keys)
        self.keys[at], self.values[at] = keys, values

    def _at(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (K.mix(keys + shift * K.U(K.P2)) % K.U(self.n)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % K.U(self.buckets)).astype(np.int64)]
        return np.where(shift >= self.DIRECT, (shift & ~self.DIRECT).astype(np.int64), self._at(keys, shift))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 for strangers."""
        at = self.slot(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Vocabulary:
    """Ranks of byte strings, with the merges that they imply."""

    #: Pre-tokens of up to these many bytes are merged many at a time.
    WIDTHS = (4, 8, 12, 16, 24, 32, 64)
    #: Pieces that are merged side by side.
    TOGETHER = 1 << 14
    NONE = np.int64(1) << 40

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.view = K.chunks(self.blob)
        self.perfect = PerfectHash(K.span_hashes(self.view, self.blob, self.starts[ids], self.starts[ids] + self.lengths[ids]), ids)
        digits = [b"%d " % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_lengths = np.fromiter(map(len, digits), np.int64, size)
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, i in ranks.items():  # each way to split a token into two tokens is a merge of its rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = i
        self.pair_hash = PerfectHash(K.mix(np.fromiter(self.pairs, K.U, len(self.pairs))), np.fromiter(self.pairs.values(), np.int64, len(self.pairs)))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two ids, NONE where there is none."""
        got = self.pair_hash.get(K.mix((a << 20 | b).astype(K.U)))
        return np.where(got < 0, self.NONE, got)

    def entries(self, hashes: np.ndarray, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of spans that are entries, -1 for others."""
        out = self.perfect.get(hashes)
        own = np.flatnonzero(out >= 0)
        own = own[self.lengths[out[own]] == size[own]]
        own = own[K.equal(view, start[own], self.view, self.starts[out[own]], size[own])]
        same = np.full(len(out), -1, np.int64)
        same[own] = out[own]
        return same

    def merge(self, piece: bytes) -> list[int]:
        """Heap over linked bytes: always the pair of lowest rank, the leftmost of equals."""
        pairs = self.pairs
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        get, width = pairs.get, n.bit_length()
        mask = (1 << width) - 1
        heap = [r << width | i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> width
            a, j = ids[i], after[i]
            if a < 0 or j >= n or get(a << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get(r << 20 | ids[k])) is not None:
                    heappush(heap, x << width | i)
            h = before[i]
            if h >= 0 and (x := get(ids[h] << 20 | r)) is not None:
                heappush(heap, x << width | h)
        return [x for x in ids if x >= 0]

    def merge_many(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short pieces at once, a column each. Rows 1, 2, ... of ``heap`` are a complete binary tree over
        the pairs, each node not above its children: row 1 is the pair of lowest rank, the leftmost of equals. A merge renews
        the entries of the pairs around it, which are sifted up to the top. Returns ids on end, and how many each piece has."""
        n = len(start)
        ids = np.full((width + 1, n), -1, np.int64)
        for i in range(width):
            own = np.flatnonzero(size > i)
            ids[i, own] = self.byte[data[start[own] + i]]
        after = np.repeat(np.arange(1, width + 2, dtype=np.int8)[:, None], n, 1)
        before = after - np.int8(2)
        leaves, none = 1 << (width - 1).bit_length(), self.NONE << 7
        heap = np.full((2 * leaves, n), none, np.int64)
        for i in range(width - 1):
            own = np.flatnonzero(size > i + 1)
            heap[leaves + i, own] = self.rank(ids[i, own], ids[i + 1, own]) << 7 | i
        for node in range(leaves - 1, 0, -1):
            np.minimum(heap[2 * node], heap[2 * node + 1], out=heap[node])
        flat, live = heap.ravel(), np.arange(n)
        while True:
            top = heap[1, live]
            live, top = live[top < none], top[top < none]
            if not len(live):
                break
            i, r = top & 127, top >> 7
            j = after[i, live].astype(np.int64)
            k = after[j, live].astype(np.int64)
            h = before[i, live].astype(np.int64)
            ids[i, live], ids[j, live], after[i, live] = r, -1, k
            heap[leaves + i, live] = heap[leaves + j, live] = none
            right, left = np.flatnonzero(k < size[live]), np.flatnonzero(h >= 0)
            col = live[right]
            before[k[right], col] = i[right]
            heap[leaves + i[right], col] = self.rank(r[right], ids[k[right], col]) << 7 | i[right]
            col = live[left]
            heap[leaves + h[left], col] = self.rank(ids[h[left], col], r[left]) << 7 | h[left]
            node, col = leaves + np.concatenate([i, j, h[left]]), np.concatenate([live, live, col])
            for _ in range(leaves.bit_length() - 1):
                node >>= 1
                flat[node * n + col] = np.minimum(flat[2 * node * n + col], flat[(2 * node + 1) * n + col])
        out = ids.T
        kept = out >= 0
        return out[kept], kept.sum(1)

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, on end, and their counts."""
        counts, low, parts = np.zeros(len(start), np.int64), 0, []
        for width in (*self.WIDTHS, None):
            own = np.flatnonzero((size > low) & (size <= width) if width else size > low)
            if not len(own):
                low = width
                continue
            if width:  # so many at a time that their heaps do not grow with the text
                done = [self.merge_many(data, start[x], size[x], width) for x in np.split(own, range(self.TOGETHER, len(own), self.TOGETHER))]
                ids, n = (np.concatenate(x) for x in zip(*done, strict=True))
            else:
                text = [self.merge(data[start[x] : start[x] + size[x]].tobytes()) for x in own.tolist()]
                ids, n = np.array([y for x in text for y in x], np.int64), np.fromiter(map(len, text), np.int64, len(text))
            counts[own] = n
            parts.append((own, ids, n))
            low = width
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for own, ids, n in parts:
            out[K.ragged(at[own], n)] = ids
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents on end, and the offsets of each document's ids."""
        start = pretokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        back, index, hashes = K.identify(data, start, end)
        table = self.entries(hashes, K.chunks(data), start[index], (end - start)[index])
        counts = np.ones(len(index), np.int64)
        missed = np.flatnonzero(table < 0)
        if len(missed):
            own = start[index[missed]]
            ids, counts[missed] = self.merged(data, own, end[index[missed]] - own)
            at = np.cumsum(counts) - counts
            whole, table = table, np.empty(int(counts.sum()), np.int64)
            table[at[whole >= 0]] = whole[whole >= 0]
            table[K.ragged(at[missed], counts[missed])] = ids
        at = np.cumsum(counts) - counts
        n = counts[back]
        ends = np.concatenate([[0], np.cumsum(n)])
        return table[K.ragged(at[back], n)], ends[np.searchsorted(start, offsets, "left")]

    def encode_around(self, data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, but each place where a document has an added token's text (the first, then the longest) is that token."""
        raw, found, at = data.tobytes(), [], 0
        pattern = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        while pattern and (m := pattern.search(raw, at)):
            inside = np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end() - 1, "right")
            found += [m] if inside else []
            at = m.end() if inside else m.start() + 1
        if not found:
            return self.encode(data, offsets)
        start = np.array([m.start() for m in found])
        cuts = np.unique(np.concatenate([offsets, start, [m.end() for m in found]]))
        ids, ends = self.encode(data, cuts)
        own = np.searchsorted(cuts, start)
        counts = np.diff(ends)
        keep = np.ones(len(ids), bool)
        keep[K.ragged(ends[own], counts[own])] = False
        keep[ends[own]] = True
        ids[ends[own]] = [added[m[0]] for m in found]
        counts[own] = 1
        return ids[keep], np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        return self.blob[K.ragged(self.starts[ids], self.lengths[ids])]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """Each id as decimal digits and one space."""
        return self.digits[K.ragged(self.digit_starts[ids], self.digit_lengths[ids])]


_kept: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    if path not in _kept:
        _kept[path] = Vocabulary(path)
    return _kept[path]


def with_tokens(docs: DataFrame, path: str, schema: str, make: Callable[..., pa.RecordBatch], added: dict[bytes, int] | None = None) -> DataFrame:
    """Apply ``make(vocabulary, rows, ids, offsets)`` to slices of (doc_id, text); ``added`` tokens are matched in running text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part, data, offsets in K.slices(batch, most=SLICE_BYTES):
                yield make(vocab, part, *vocab.encode_around(data, offsets, added or {}))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""

    def make(vocab: Vocabulary, part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return with_tokens(docs.selectExpr("cast(doc_id as long) doc_id", "text"), path, "doc_id long, ids array<int>", make)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of each row's ids (null: empty); the inverse of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [vocab.decode(np.array(x, np.int64)).tobytes() if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return ids.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digest of the encoding and of its decoding, per document."""

    def make(vocab: Vocabulary, part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        decimals, decoded = vocab.decimals(ids).tobytes(), vocab.decode(ids).tobytes()
        cut = np.concatenate([[0], np.cumsum(vocab.digit_lengths[ids])])[offsets].tolist()
        back = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])[offsets].tolist()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        n = range(len(offsets) - 1)
        return pa.record_batch(
            [
                part.column(0),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([sha(decimals[cut[i] : max(cut[i], cut[i + 1] - 1)]) for i in n], pa.string()),
                pa.array([sha(decoded[back[i] : back[i + 1]]) for i in n], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return with_tokens(docs.selectExpr("cast(doc_id as long) doc_id", "text"), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
