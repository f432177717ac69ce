"""Clustering, projection and probes of embeddings, on Spark's own estimators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .order import numbered, written


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def project(rows: DataFrame, column: str, dims: int = 2) -> DataFrame:
    """Principal components of centred vectors, as columns pc1, pc2, ..."""
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    v = _vectors(rows, column)
    v = centred.fit(v).transform(v)
    out = PCA(k=dims, inputCol="centred", outputCol="pcs").fit(v).transform(v)
    pcs = vector_to_array("pcs")
    return out.select(*rows.columns, *[pcs[i].alias(f"pc{i + 1}") for i in range(dims)])


def cluster(rows: DataFrame, column: str, choices: list[int], seed: int = 0) -> tuple[DataFrame, int, float]:
    """(rows with ``cluster``, chosen k, silhouette): k-means for each k, the highest silhouette wins (squared
    Euclidean, as Spark measures it)."""
    v, best = _vectors(rows, column).cache(), None
    for k in choices:
        out = KMeans(k=k, seed=seed).fit(v).transform(v)
        score = ClusteringEvaluator(predictionCol="prediction").evaluate(out)
        if best is None or score > best[2]:
            best = (out, k, score)
    return best[0].select(*rows.columns, F.col("prediction").alias("cluster")), best[1], best[2]


def enrichment(rows: DataFrame, features: list[str], by: str = "cluster") -> DataFrame:
    """How much more often a feature is true within a cluster than outside, with chi-square p and q."""
    pairs = ", ".join(f"'{f}', {f}" for f in features)
    long = rows.select(by, F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)")).withColumn("value", F.coalesce("value", F.lit(False)))
    cells = long.groupBy(by, "feature").agg(F.sum(F.col("value").cast("long")).alias("n11"), F.sum((~F.col("value")).cast("long")).alias("n10"))
    all_cells = cells.groupBy("feature").agg(F.sum("n11").alias("t1"), F.sum("n10").alias("t0"))
    out = cells.join(all_cells, "feature").withColumns({"n01": F.col("t1") - F.col("n11"), "n00": F.col("t0") - F.col("n10")})
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    out = stats.chi2_p(out.withColumn("enrichment", rate("n11", "n10") - F.coalesce(rate("n01", "n00"), F.lit(0.0))))
    return stats.bh_qvalues(out.withColumn("family", F.lit(0)), ["family"], "p", "feature").select(by, "feature", "enrichment", "p", "q")


def soft_rows(rows: DataFrame, share: str) -> DataFrame:
    """Each row twice, as a positive weighted by its share and a negative by the rest; empty weights go."""
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col(share).alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(share)).alias("weight"))))
    return rows.withColumn("__b", both).select(*rows.columns, F.col("__b.label").alias("label"), F.col("__b.weight").alias("weight")).where("weight > 0")


def folds(rows: DataFrame, label: str, key: str, n: int = 5, seed: int = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """Stratified: within a label (of each group ``within``), rows are dealt out in the order of a hash. Rows are numbered in sorted
    ranges, so that no task has all rows of a label."""
    by = [*within, label]
    placed = numbered(rows, "__turn", *by, F.xxhash64(key, F.lit(seed)), key)
    first = placed.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.min("__turn").alias("__first"))
    same = F.col(by[0]).eqNullSafe(F.col(f"__of_{by[0]}"))
    for c in by[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(first, same).select(*rows.columns, ((F.col("__turn") - F.col("__first")) % n).cast("int").alias("fold"))


def probe(rows: DataFrame, column: str, label: str, key: str, n: int = 5, c: float = 1.0, shuffle: int | None = None, share: str | None = None) -> DataFrame:
    """AUROC of a logistic probe on each held-out fold; ``shuffle`` deals the labels out anew (the null). With ``share``, a
    row trains as a positive of this weight and a negative of the rest; it is held out with its own label."""
    v = _vectors(rows, column).withColumn("label", F.col(label).cast("double"))
    if shuffle is not None:
        a = numbered(v.drop("label"), "__i", key)
        v = a.join(numbered(v.select("label", key), "__i", F.xxhash64(key, F.lit(shuffle)), key).drop(key), "__i")
    v = folds(v, "label", key, n).cache()
    out = None
    for fold in range(n):
        train = v.where(F.col("fold") != fold)
        train = train.withColumn("weight", F.lit(1.0)) if share is None else soft_rows(train.drop("label"), share)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
        learner = LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=1.0 / (c * max(1, train.count())), elasticNetParam=0.0)
        model = learner.fit(scaler.transform(train))
        scored = model.transform(scaler.transform(v.where(F.col("fold") == fold))).select("fold", "label", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return stats.auroc(out, ["fold"], "label", "score")


def _dealt(rows: DataFrame, label: str, key: str, n_perm: int, n: int) -> DataFrame:
    """(key, deals): for each deal of the labels, in order, a row's label and fold."""
    many = rows.select(F.col(label).cast("double").alias("label"), key)
    total = many.count()
    places = numbered(rows.select(key), "__i", key)
    deals = many.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    deals = numbered(deals, "__i", "perm", F.xxhash64(key, "perm"), key).select("perm", "label", (F.col("__i") - F.col("perm") * total).alias("__i"))
    dealt = folds(deals.join(places, "__i").select("perm", "label", key), "label", key, n, within=("perm",))
    return dealt.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("perm", "label", "fold"))).alias("deals"))


def _matrices(batch: pa.RecordBatch, n_perm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with a last one of ones, labels and folds of each deal."""
    x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
    deals = batch.column("deals").flatten()
    shape = (batch.num_rows, n_perm)
    return np.column_stack([x, np.ones(len(x))]), deals.field("label").to_numpy(zero_copy_only=False).reshape(shape), deals.field("fold").to_numpy(zero_copy_only=False).reshape(shape)


def probe_null(rows: DataFrame, column: str, label: str, key: str, n_perm: int, n: int = 5, c: float = 1.0, steps: int = 25) -> DataFrame:
    """(perm, fold, auroc, ...): the probe under ``n_perm`` deals of the labels, all fitted together. Each of Newton's steps is one
    job: tasks add up the gradients and Hessians of all models over their rows, and a group for each model takes its step.
    So there are as many jobs for a thousand deals as for one. The driver sees the models, n_perm * n * dimensions numbers."""
    spark, kind = rows.sparkSession, "perm int, fold int, w binary, moved double"
    data = rows.select(key, F.col(column).cast("array<double>").alias("x")).join(_dealt(rows, label, key, n_perm, n), key)
    data = written(data.select("x", F.transform("deals", lambda d: F.struct(d["label"].alias("label"), d["fold"].alias("fold"))).alias("deals")), "probe-rows")
    first = data.select(F.size("x").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "perm int, fold int, auroc double, positives long, negatives long")
    d = first.d + 1

    def sums(weights: np.ndarray | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = np.zeros((n_perm, n, d)), np.zeros((n_perm, n, d, d))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, held = _matrices(batch, n_perm)
                for p in range(n_perm):
                    for f in range(n):
                        own = held[:, p] != f
                        z = x[own]
                        if weights is None:  # moments, for the penalty's scale
                            one[p, f] += z.sum(0)
                            two[p, f, 0] += (z * z).sum(0)
                        else:
                            q = 1 / (1 + np.exp(-(z @ weights[p, f])))
                            one[p, f] += z.T @ (q - (y[own, p] == 1))
                            two[p, f] += (z * (q * (1 - q))[:, None]).T @ z
            flat = np.concatenate([one.reshape(n_perm * n, -1), two.reshape(n_perm * n, -1)], 1)
            at = np.arange(n_perm * n)
            yield pa.record_batch([pa.array(at // n, pa.int32()), pa.array(at % n, pa.int32()), pa.array([r.tobytes() for r in flat], pa.binary())], ["perm", "fold", "part"])

        return run

    def totals(table: pa.Table) -> tuple[int, int, np.ndarray]:
        whole = sum(np.frombuffer(b.as_buffer(), float) for b in table.column("part"))
        return table.column("perm")[0].as_py(), table.column("fold")[0].as_py(), whole

    def result(p: int, f: int, w: np.ndarray, moved: float) -> pa.Table:
        return pa.table({"perm": pa.array([p], pa.int32()), "fold": pa.array([f], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "moved": [moved]})

    def scale(table: pa.Table) -> pa.Table:
        p, f, s = totals(table)
        m = s[d - 1]
        spread = (s[d : 2 * d] - s[:d] ** 2 / max(m, 1)) / max(m - 1, 1)
        return result(p, f, np.append(spread[:-1], 0) / c, 0.0)

    def step(weights: np.ndarray) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            p, f, s = totals(table)
            w, ridge = weights[p, f], penalty[p, f]
            hessian = s[d:].reshape(d, d) + np.diag(ridge) + 1e-9 * np.eye(d)
            move = np.linalg.solve(hessian, s[:d] + ridge * w)
            return result(p, f, w - move, float(np.abs(move * np.sqrt(np.append(ridge[:-1] * c, 1))).max()))

        return run

    def fetch(job: DataFrame) -> tuple[np.ndarray, float]:
        out, moved = np.zeros((n_perm, n, d)), 0.0
        for r in job.collect():
            out[r.perm, r.fold] = np.frombuffer(r.w, float)
            moved = max(moved, r.moved)
        return out, moved

    parts = "perm int, fold int, part binary"
    penalty, _ = fetch(data.mapInArrow(sums(None), parts).groupBy("perm", "fold").applyInArrow(scale, kind))
    weights = np.zeros((n_perm, n, d))
    for _ in range(steps):
        weights, moved = fetch(data.mapInArrow(sums(weights), parts).groupBy("perm", "fold").applyInArrow(step(weights), kind))
        if moved < 1e-7:
            break

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, held = _matrices(batch, n_perm)
                score = np.stack([np.einsum("ij,ij->i", x, weights[p, held[:, p]]) for p in range(n_perm)], 1)
                perm = np.tile(np.arange(n_perm, dtype=np.int32), len(x))
                yield pa.record_batch([pa.array(perm), pa.array(held.ravel().astype(np.int32)), pa.array(y.ravel()), pa.array(score.ravel())], ["perm", "fold", "label", "score"])

    return stats.auroc(data.mapInArrow(scores, "perm int, fold int, label double, score double"), ["perm", "fold"], "label", "score")


def conditional_auroc(rows: DataFrame, given: str, label: str, score: str, keys: list[str]) -> DataFrame:
    """AUROC of a score among the rows where another feature holds, and among those where it does not (``given`` as a key)."""
    return stats.auroc(rows.where(F.col(given).isNotNull()), [*keys, given], label, score)
