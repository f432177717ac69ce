"""The permutation null fitted as one job, against a loop of probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambdalake.functions import learning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 6)) * [1, 5, 0.2, 1, 1, 3] + 2
    y = (x[:, 0] + rng.normal(size=240) > 2).astype(int)
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y int")


def test_folds_are_stratified(rows):
    got = learning.folds(rows, "y", "id", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in got if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_null_equals_the_loop(rows):
    got = {(r.perm, r.fold): r.auroc for r in learning.probe_null(rows, "v", "y", "id", 3).collect()}
    assert len(got) == 15
    for perm in range(2):
        for r in learning.probe(rows, "v", "y", "id", shuffle=perm).collect():
            assert got[perm, r.fold] == pytest.approx(r.auroc, abs=0.004)
    assert 0.35 < np.mean(list(got.values())) < 0.65


def test_jobs_do_not_grow_with_deals(spark, rows):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"null-{n}", "")
        learning.probe_null(rows, "v", "y", "id", n, steps=2).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"null-{n}"))

    assert jobs(12) <= jobs(1) + 2


def test_null_of_no_rows(rows):
    assert learning.probe_null(rows.limit(0), "v", "y", "id", 2).collect() == []


def test_conditional_auroc(spark):
    rng = np.random.default_rng(2)
    data = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.integers(0, 20, 200), strict=True)]
    got = learning.conditional_auroc(spark.createDataFrame(data, "given int, y int, s double").withColumn("k", F.lit(1)), "given", "y", "s", ["k"]).collect()
    for r in got:
        pos, neg = ([s for g, y, s in data if g == r.given and y == t] for t in (1, 0))
        assert r.auroc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
    assert len(got) == 2
