"""Operator 13 against a tree in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lambdalake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, path string, tree int, pos int, found int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(siblings of each level of each node as (left, right), root)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            run = nodes[at[k] // 3 * 3 : at[k] // 3 * 3 + 3]
            p.append(("".join(run[: at[k] % 3]), "".join(run[at[k] % 3 + 1 :])))
            at[k] //= 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return paths, nodes[0]


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r, leaf(*r)) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in sources}
    built = {s: climb([h for _, h in trees[s]]) for s in sources}
    tops, root = climb([built[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (row, h), path in zip(trees[s], built[s][0], strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            at = leaf(*row[:4], row[4].replace("\n", "")) if tampered else h
            for left, right in path + top:
                at = H(left, at, right)
            out.append((row[0], h, built[s][1], root, H(*[x for pair in path + top for x in pair]), at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_python(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = []
    for source, n in [("a", 1), ("b", 3), ("c", 4), ("é", 27), ("hot", 95), (None, 10), ("", 2), *[(f"s{i}", 1 + i % 2) for i in range(20)]]:
        rows += [(rng.randrange(10**6), source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "x\ny", "Zeile\n\nzwei é", "long " * 5000])) for _ in range(n)]
    rows += [(7, "b", "en", 1, "same\n")] * 3 + [(7, "b", "en", 2, "other\n"), (None, "b", None, None, "x\n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.report(docs).collect()), key=repr)
    assert got == brute(rows)
    assert 20 < sum(not r[6] for r in got) < len(got) - 20


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.report(none).collect() == []
    one = spark.createDataFrame([(1, "a", "en", 2, "x\n", "p", 1, 2, 3)], SCHEMA)
    assert tuple(merkle.report(one).first()) == brute([(1, "a", "en", 2, "x\n")])[0]


def test_proofs_hold(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "en", i, f"text {i}", "p", 1, 2, 3) for i in range(100)], SCHEMA)
    proofs = merkle.manifest(docs)
    assert proofs.columns == ["doc_id", "source", "leaf", "path", "subroot", "root"]
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 100
    assert proofs.where(merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_batches_are_cut_between_blocks(spark):
    """More leaves in a task than the engine takes at a time."""
    n = 80_000
    docs = spark.range(n).selectExpr("id doc_id", "concat('s', id % 3) source", "'en' lang", "1 n_chars", "cast(id as string) text")
    proofs = merkle.manifest(docs.coalesce(1))
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == n
    assert proofs.select("root").distinct().count() == 1
