"""Operator 11 against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

from lambdalake.llm import minhash
from lambdalake.llm import kernels as K

SCHEMA = "doc_id long, text string, n string, bands int, sketch int"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    out = []
    for (i, _), s, r in zip(rows, sets, root, strict=True):
        ids = [k for (k, _), q in zip(rows, root, strict=True) if q == r and k is not None]
        c = min(ids, default=None) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.report(docs).collect()), key=repr)


def changed(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"z{rng.getrandbits(40)}"
    return out


def test_pairs_on_both_sides(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        base = [f"W{rng.getrandbits(30)}" for _ in range(rng.randint(30, 300))]
        texts += [" ".join(base), " ".join(base + changed(base, rng, 0)[: rng.randint(0, len(base) // 4)]), " ".join(changed(base, rng, rng.randint(0, 1 + len(base) // 50)))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = brute(rows)
    assert 70 < sum(r[3] for r in want) < 170
    assert found(spark, rows) == want


def test_crowded_template(spark):
    """Copies with changes of one text, of which many are below the similarity to each other and some to all."""
    rng = random.Random(2)
    base = [f"w{rng.getrandbits(30)}" for _ in range(200)]
    texts = [" ".join(changed(base, rng, rng.randint(0, 9))) for _ in range(150)] + [" ".join(base[k:]) for k in range(0, 60, 3)]
    assert found(spark, list(enumerate(texts))) == brute(list(enumerate(texts)))


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (7, "other words are here now"), (None, "a b c d e"), (None, "lonely null id text of words"), (8, long), (9, long + " end"), (3, "one two"), (10, "É é É é É"), (11, "é é é é é")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert (4, 1, 3, False) in got and (9, 29_997, 8, False) in got and (None, 2, None, True) in got
    assert minhash.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_never_rejects_a_link(spark):
    """Ones of the XOR are at most the difference of the sets, and close to it when it is small."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 1000)).astype(K.U))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, 5).astype(K.U)]))[: minhash.SAMPLES]
        differ = len(np.setxor1d(a, b))
        x, y = minhash.odd_sketch([a, b])
        ones = int(np.bitwise_count((x ^ y).view(K.U)).sum())
        assert ones <= differ and ones >= 0.8 * differ - 2
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-10


@pytest.mark.parametrize("n", [0, 1])
def test_min_hashes_of_few(n):
    own = np.arange(n + 1)
    assert minhash.bands(minhash.min_hashes(np.arange(n, dtype=K.U), own)).shape == (n, minhash.BANDS)
