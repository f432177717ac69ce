"""Sketches are expanded as a whole: no filling is left out, however many there are."""

import itertools

import pyspark.sql.functions as F

from lambdalake.operators import corpus
from lambdalake.queries import corpus as queries


def test_every_filling_of_a_sketch_counts(spark, tmp_path):
    """The query against all fillings made one by one: of a behaviour's programs the one of the least place, then of the least text."""
    spark.createDataFrame([(i, i % 3 + 1) for i in range(24)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sizes = {r.program: r.size for r in queries.sketches(spark, str(tmp_path)).collect()}
    filled = []
    for sketch, size in sizes.items():
        parts = sketch.split("int_hole")
        for place, own in enumerate(itertools.product(corpus.SEED_CONSTANTS, repeat=len(parts) - 1)):
            filled.append((parts[0] + "".join(str(c) + p for c, p in zip(own, parts[1:], strict=True)), size, place))
    assert len(filled) == 3 * (11 + 121 + 121 + 1)
    first = {}
    for r in corpus.evaluate(spark.createDataFrame(filled, "program string, size int, place long")).where(corpus.good(F.col("fp"))).collect():
        own = (r.place, r.program, r.size)
        first[tuple(r.fp)] = min(first.get(tuple(r.fp), own), own)
    got = queries.queries()["expand_sketches"](spark, str(tmp_path)).collect()
    assert sorted((r.place, r.program, r.size) for r in got) == sorted(first.values())
    assert max(r.place for r in got) > 3


def test_fillings_in_blocks(spark):
    """More fillings than one block has."""
    rows = spark.createDataFrame([(f"({'int_hole ' * 5})", 1), ("(f)", 2), (None, 3), ("(int_hole)", 4)], "program string, size int")
    got = corpus.expand(rows)
    assert 11**5 > 2 * corpus.BLOCK and got.count() == 11**5 + 1 + 11
    large = got.where("size = 1").select("program", "place", "substitution").collect()
    assert {r.place: r.substitution for r in large} == dict(enumerate(map(list, itertools.product(range(11), repeat=5))))
    assert all(r.program == "(" + "".join(f"{c} " for c in r.substitution) + ")" for r in large)
    assert corpus.expand(rows.where("program is not null"), most=50).count() == 50 + 1 + 11


def test_more_fillings_than_an_array_has_elements(spark):
    got = corpus.expand(spark.createDataFrame([(f"({'int_hole ' * 10})",)], "program string")).limit(5).collect()
    assert len(got) == 5
    for r in got:
        assert r.substitution == [r.place // 11 ** (9 - i) % 11 for i in range(10)]
