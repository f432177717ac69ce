"""Operator 12 against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from lambdalake.llm import resampling

SCHEMA = "doc_id long, text string, weight string, bucket int, rank int"


def parts(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def brute(rows, target):
    s, t = sum((parts(x)[1] for _, x in rows), Counter()), sum((parts(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10_000)) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for i, text in rows:
        w, f = parts(text)
        weight = sum(gain[b] * n for b, n in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able):
        r[4] = rank + 1 if rank < 25 * len(able) // 100 else None
    return sorted((tuple(r[:4]) + (r[4] if r in able else None,) for r in out), key=repr)


def test_against_python(spark):
    words = ["Über", "x1", "the", "THE", "a-b", "日本語", "naïve", "q" * 63, "q" * 64, "q" * 65, "long" * 500, "\x00", "e", "z9"]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(200)]
    rows += [(5, "the " * 30), (5, "the " * 30), (None, "a b " * 20), (201, None), (202, ""), (203, " ,. "), (204, "unbroken" * 200_000), (205, "A" * 25 + " end")]
    target = ["the naïve x1 " * 30, None, "日本語 the"]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.report(docs, aims).collect()), key=repr)
    assert got == brute(rows, target)
    assert sum(r[4] is not None for r in got) > 30
    none = aims.limit(0)
    assert sorted((tuple(r) for r in resampling.report(docs, none).collect()), key=repr) == brute(rows, [])
    assert resampling.report(docs.limit(0), aims).collect() == []


def test_words_never_cross_documents():
    texts = [b"ab", b"cd ef", b"", b"gh"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    row, bucket, n_words = resampling.features(data, offsets)
    want = [(i, b) for i, t in enumerate(texts) for b in parts(t.decode())[1].elements()]
    assert sorted(zip(row.tolist(), bucket.tolist(), strict=True)) == sorted(want) and n_words.tolist() == [1, 2, 0, 1]
