"""Work is dealt over tasks and done once for equal inputs; no task grows by the square of its rows."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from lambdalake.functions import stats
from lambdalake.operators import corpus, variants
from lambdalake.queries import corpus as corpus_queries
from lambdalake.queries import scopes


def test_evaluation_is_dealt_out(spark):
    texts = ["(λ (x) (take 1 x))", "(λ (x) (reverse x))", None, "("]
    rows = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "i int, program string").coalesce(1)
    got = corpus.evaluate(rows)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = {}
    for r in got.collect():
        assert seen.setdefault(r.program, r.fp) == r.fp
    assert len(seen) == 4 and seen[None] is None and seen["("] is None and seen["(λ (x) (reverse x))"][2] == "[2,1,3]"


def test_sketches_are_evaluated_once(spark, tmp_path, monkeypatch):
    """Parts of one size share their sketches, so a sketch of several parts is evaluated as one row."""
    spark.createDataFrame([(i, i % 3) for i in range(240)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sizes, plain = [], corpus.evaluate
    monkeypatch.setattr(corpus, "evaluate", lambda rows: sizes.append((rows.count(), rows.select("program").distinct().count())) or plain(rows))
    got = corpus_queries.queries()["expand_sketches"](spark, str(tmp_path)).collect()
    assert sizes[0][0] == sizes[0][1]
    first = {}
    for r in plain(corpus.expand(corpus_queries.sketches(spark, str(tmp_path)), most=3)).where(corpus.good(F.col("fp"))).collect():
        own = (r.place, r.program, r.size)
        first[tuple(r.fp)] = min(first.get(tuple(r.fp), own), own)
    assert sorted((r.place, r.program, r.size) for r in got) == sorted(first.values())


def test_fingerprints_once_for_each_pair_of_constants(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7 + 1, float(i % 5 + 1)) for i in range(700)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, plain = [], scopes.written
    monkeypatch.setattr(scopes, "written", lambda df, name: made.append(plain(df, name)) or made[-1])
    got = scopes.contextual(spark, str(tmp_path)).collect()
    assert made[0].count() == 35 and len(got) == 700
    # (+ (* v a) b) at v = 0, 1, 3 for each of the ten test inputs
    assert all(r.scaled == "|".join(str(v * r.l_linenumber + (r.l_orderkey % 5 + 1)) for _ in range(10) for v in (0, 1, 3)) for r in got)


def starts_anew(df):
    """Whether a window's frame ends with its partition and starts at the row: its work is the square of the partition."""
    return re.search(r"specifiedwindowframe\(RowFrame, (currentrow\$\(\)|\d+), unboundedfollowing", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_looking_ahead_costs_no_square(spark):
    rng = random.Random(4)
    rows = [(i, g, [i] if g < 2 and rng.random() < 0.02 else []) for i in range(3000) for g in range(3)]
    df = spark.createDataFrame(rows, "i long, g int, pool array<long>").repartition(3)
    got = corpus.redirect_empty(df, "i", ["g"])
    assert not starts_anew(got)
    have = {g: [i for i, h, pool in rows if h == g and pool] for g in range(3)}
    for r in got.collect():
        own = have[r.g]
        assert r.served == ([own[bisect.bisect_left(own, r.i) % len(own)]] if own else None)


def test_templates_go_to_the_programs(spark):
    """Whatever the sizes look like, it is not the programs that are gathered at the driver and broadcast."""
    programs = spark.range(50).selectExpr("id i", "'(λ (x) (take 2 (reverse x)))' program")
    got = variants.variants(programs, "i")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"BroadcastHashJoin \[primitive#\d+\], \[primitive#\d+\], Inner, BuildRight", plan)
    assert got.count() == 50 * sum(t[1] in ("take", "reverse") for t in variants.TEMPLATES)


def test_qvalues_cost_no_square(spark):
    rng = random.Random(2)
    rows = [(i, g, None if rng.random() < 0.05 else round(rng.random(), 2)) for i in range(400) for g in range(2)]
    got = stats.bh_qvalues(spark.createDataFrame(rows, "i int, g int, p double"), ["g"], "p", "i")
    assert not starts_anew(got) and got.columns == ["i", "g", "p", "q"]
    q = {(r.g, r.i): r.q for r in got.collect()}
    for g in range(2):
        own = sorted(((p is not None, p or 0.0, i) for i, h, p in rows if h == g))
        least = 1.0
        for rank in range(len(own), 0, -1):
            known, p, i = own[rank - 1]
            least = min(least, p * len(own) / rank) if known else least
            assert q[g, i] == pytest.approx(least)
    times = spark.createDataFrame([(0, rng.random(), 1, i % 2) for i in range(50)], "g int, t double, e int, s int")
    assert not starts_anew(stats.log_rank(times, ["g"], "t", "e", "s"))


def test_scores_of_a_group_are_spread(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), int(rng.random() < 0.3), rng.choice([None, round(rng.random(), 2)])) for _ in range(600)]
    got = stats.auroc(spark.createDataFrame(rows, "g string, y int, s double").coalesce(1), ["g"], "y", "s")
    assert "windowspecdefinition(g#" not in got._jdf.queryExecution().executedPlan().toString()
    low = lambda s: -1.0 if s is None else s
    for r in got.collect():
        p, q = ([low(s) for g, y, s in rows if g == r.g and y == k] for k in (1, 0))
        assert (r.positives, r.negatives) == (len(p), len(q))
        assert r.auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)))


def test_enumerated_values_are_not_sorted(spark, tmp_path):
    spark.createDataFrame([(i // 3, float(i % 9)) for i in range(90)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = scopes.enumerated(spark, str(tmp_path))
    assert "SortAggregate(key=[program" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.program, r.type): tuple(r)[2:] for r in got.collect()}
    assert found["(length x)", "int"] == (30, 30, "3", "3") and found["x", "list[int]"][:1] == (30,)
