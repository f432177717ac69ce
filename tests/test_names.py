"""Programs under names of each row's own: batches as arrays, against hashes and lexemes taken one by one."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambdalake.functions.digests import md5_of_pairs
from lambdalake.operators import corpus
from lambdalake.queries import scopes

TEXTS = ["(λ (x) (take 2 (map (λ (y) (+ y 1)) x)))", "take", "", None, " (+\t12ab ab12 -5 [1 2]\x0b take)λ+ ", "(max x  max) ü+ (min 3 sum)"]


def plain(row, text, names, k):
    if row is None:
        return text and " ".join(re.findall(corpus.LEXEME, text, re.ASCII)), None if text is None else [], False
    hashed = lambda salt, xs: [n for _, n in sorted((hashlib.md5(f"{salt}:{row}:{n}".encode()).hexdigest(), n) for n in xs)]
    picked = set(names if k is None else hashed("pick", names)[: max(k, 0)])
    own = [n for n in names if n in picked]
    into = dict(zip(own, hashed("to", own), strict=True))
    if text is None:
        return None, None, True
    lexemes = re.findall(corpus.LEXEME, text, re.ASCII)
    used = sorted({(into[t], t) for t in lexemes if t in into})
    return " ".join(into.get(t, t) for t in lexemes), [f"{a}={b}" for a, b in used], True


def check(spark, names, k):
    ids = [None, "", "7-1", "1234567-3", "ä" * 9, "long " * 20] + [f"{i}-{i % 7}" for i in range(60)]
    rows = [(i, r, t, i % (len(names) + 4) - 2) for i, (r, t) in enumerate((r, t) for r in ids for t in TEXTS)]
    df = spark.createDataFrame(rows, "i int, id string, text string, k int")
    got = {r.i: (r.program, r.preamble, r.bijection) for r in corpus.renamed(df, F.col("id"), F.col("text"), names, k).collect()}
    assert len(got) == len(rows)
    for i, r, t, most in rows:
        assert got[i] == plain(r, t, names, None if k is None else most), (i, r, t, most)


def dear(df):
    """Whether rows are hashed or scanned by expressions, name by name."""
    return re.search(r"md5\(|regexp_extract_all\(", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_hashes_of_pairs():
    heads, tails = [b"x" * i for i in range(80)], [b"", b"+", b"is_even", b"y" * 40]
    wanted = np.random.default_rng(1).random((80, 4)) < 0.5
    got = md5_of_pairs(np.frombuffer(b"".join(heads), np.uint8), np.cumsum([0, *map(len, heads)]), tails, wanted)
    for i, head in enumerate(heads):
        for j, tail in enumerate(tails):
            assert got[:, j, i].astype(">u8").tobytes() == (hashlib.md5(head + tail).digest() if wanted[i, j] else bytes(16))


@pytest.mark.parametrize("names", [scopes.NAMES, ["take", "+", "max"], ["max"]])
def test_all_names(spark, names):
    check(spark, names, None)
    assert not dear(scopes.queries()["symbols_permuted"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("names", [scopes.NAMES, ["take", "+", "max"], ["max"]])
def test_names_that_a_row_picks(spark, names):
    check(spark, names, F.col("k"))
    assert not dear(scopes.queries()["symbols_partly_permuted"](spark, "/root/testdata/sf0.001"))
