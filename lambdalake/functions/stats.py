"""Statistics as DataFrame aggregations. Ranks come from counts by value, so that ties and large groups
cost what the distinct values cost; resampling statistics run per group in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .order import running_total, written


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > x); there is no erfc in SQL."""
    return x.map(lambda v: math.erfc(math.sqrt(max(0.0, v) / 2)) if v == v else float("nan"))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def midranks(rows: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of each value within its group."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(name, F.sum("__n").over(w) - (F.col("__n") - 1) / 2).drop("__n")
    return rows.join(ranks, [*keys, value])


def spread_midranks(rows: DataFrame, keys: list[str], value: str, name: str = "rank", among: DataFrame | None = None) -> DataFrame:
    """``midranks`` for few, large groups (or one, without keys): the different values are summed up by sorted ranges, so that no task
    has all values of a group. ``among``: the same rows, where they can be had more cheaply."""
    counts = running_total((rows if among is None else among).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), "__before", "__n", *keys, value)
    if keys:
        base = counts.groupBy(*keys).agg(F.min("__before").alias("__base"))
        counts = counts.join(base, keys)
    else:
        counts = counts.withColumn("__base", F.lit(0))
    ranks = counts.select(*keys, value, (F.col("__before") - F.col("__base") + (F.col("__n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def auroc(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Chance that a positive outscores a negative, ties half. The different scores are summed up by sorted ranges, so that no task has
    all scores of a group."""
    counts = rows.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    below = running_total(counts, "__below", "q", *keys, score)
    # The running total goes on from group to group; what a group begins with is its least.
    wins = F.sum(F.col("p") * (F.col("__below") + F.col("q") / 2)) - F.min("__below") * F.sum("p")
    return below.groupBy(*keys).agg((wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auroc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midranks(midranks(known, keys, x, "__rx"), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("__rx", "__ry")).alias("rho"))


def pearson(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.corr(x, y)).alias("r"))


def signed_rank(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Wilcoxon's statistic on paired values: the smaller sum of ranks of absolute differences; zeros go."""
    d = rows.withColumn("__d", F.col(x) - F.col(y)).where("__d != 0").withColumn("__size", F.abs("__d"))
    ranked = midranks(d, keys, "__size", "__r")
    up, down = F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0)), F.sum(F.when(F.col("__d") < 0, F.col("__r")).otherwise(0))
    return ranked.groupBy(*keys).agg(F.least(up, down).alias("statistic"), F.count(F.lit(1)).alias("n"))


def signed_rank_test(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The statistic with its two-sided p, as ``signed_rank_p``: ranks and sums are aggregated, p is found for each group."""
    d = rows.withColumn("__d", F.col(x) - F.col(y)).where("__d != 0").withColumn("__size", F.abs("__d"))
    counts = d.groupBy(*keys, "__size").agg(F.count(F.lit(1)).alias("__t")).groupBy(*keys).agg(F.sum(F.col("__t") ** 3 - F.col("__t")).alias("__ties"))

    @F.pandas_udf(DoubleType())
    def p(statistic: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([_signed_rank_tail(float(t), int(k), float(c)) for t, k, c in zip(statistic, n, ties, strict=True)], dtype=float)

    return signed_rank(rows, keys, x, y).join(counts, keys).withColumn("p", p("statistic", "n", "__ties")).drop("__ties")


def _signed_rank_tail(t: float, n: int, ties: float) -> float:
    """Two-sided p of a rank sum: exact up to 50 without ties, else normal with the ties' correction."""
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return float(min(1.0, 2 * ways[: int(t) + 1].sum() / ways.sum()))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(t - mean) / math.sqrt(var) / math.sqrt(2))) if var else 1.0


def signed_rank_p(differences: np.ndarray) -> float:
    """Two-sided p of one sample of differences: exact by the distribution of rank sums up to 50 without ties, else normal."""
    d = np.asarray(differences, float)
    d = d[(d != 0) & ~np.isnan(d)]
    n = len(d)
    if not n:
        return 1.0
    size = np.abs(d)
    order, ranks = np.argsort(size, kind="stable"), np.empty(n)
    values, first, count = np.unique(size[order], return_index=True, return_counts=True)
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    t = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    return _signed_rank_tail(t, n, float((count**3 - count).sum()))


def bh_qvalues(rows: DataFrame, family: list[str], p: str = "p", tie: str | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within each family: the least p * n / rank from here up, 1 at most. The least one is taken
    downwards from the last rank: Spark starts a frame that ends with its partition anew for each row."""
    by = Window.partitionBy(*family)
    rows = rows.withColumn("__rank", F.row_number().over(by.orderBy(p, *([tie] if tie else []))))
    rows = rows.withColumn("__s", F.col(p) * F.count(F.lit(1)).over(by) / F.col("__rank"))
    down = by.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q", F.least(F.lit(1.0), F.min("__s").over(down))).drop("__s", "__rank")


def chi2_statistic(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """2x2 independence without correction; NULL where a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / below)


def chi2_p(counts: DataFrame) -> DataFrame:
    """With ``p``: 1 where a margin is empty."""
    x = chi2_statistic(*[F.col(c) for c in ("n11", "n10", "n01", "n00")])
    return counts.withColumn("chi2", x).withColumn("p", F.when(F.col("chi2").isNull(), 1.0).otherwise(chi2_tail(F.coalesce("chi2", F.lit(0.0)))))


def log_rank(rows: DataFrame, keys: list[str], time: str, event: str, group: str) -> DataFrame:
    """Two-sample log-rank chi-square of groups 0 and 1: from counts by time, at-risk numbers from a window."""
    at = rows.groupBy(*keys, time).agg(
        *[F.sum(F.when(F.col(group) == g, 1).otherwise(0)).alias(f"n{g}") for g in (0, 1)],
        F.sum(F.when((F.col(event) > 0) & (F.col(group) == 0), 1).otherwise(0)).alias("d0"),
        F.sum(F.when(F.col(event) > 0, 1).otherwise(0)).alias("d"),
    )
    on = Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    risk = at.select(*keys, F.sum("n0").over(on).cast("double").alias("r0"), F.sum("n1").over(on).cast("double").alias("r1"), "d0", "d")
    risk = risk.withColumn("r", F.col("r0") + F.col("r1")).where("r >= 2 and d > 0")
    expected = F.sum(F.expr("d * r0 / r"))
    variance = F.sum(F.expr("d * r0 * r1 * (r - d) / (r * r * (r - 1))"))
    out = risk.groupBy(*keys).agg(F.sum("d0").alias("observed"), expected.alias("expected"), variance.alias("variance"))
    x = (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")
    return out.withColumn("chi2", F.when(F.col("variance") > 0, x).otherwise(0.0))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings, from their contingency table."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = cells.withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nb", F.sum("n").over(Window.partitionBy(b)))
    total = cells.agg(F.sum("n").alias("t"))
    choose = lambda c: c * (c - 1) / 2
    left = cells.groupBy(a).agg(F.first("na").alias("m")).agg(F.sum(choose(F.col("m"))).alias("pa"), F.sum(F.col("m") * F.log("m")).alias("ha"))
    right = cells.groupBy(b).agg(F.first("nb").alias("m")).agg(F.sum(choose(F.col("m"))).alias("pb"), F.sum(F.col("m") * F.log("m")).alias("hb"))
    joint = cells.agg(F.sum(choose(F.col("n"))).alias("pj"), F.sum(F.col("n") * F.log("n")).alias("hj"))
    # Four one-row tables side by side: their join key is a constant.
    one = F.lit(1).alias("k")
    table = total.select("*", one)
    for t in (left, right, joint):
        table = table.join(t.select("*", one), "k")
    all_pairs = choose(F.col("t"))
    expected = F.col("pa") * F.col("pb") / all_pairs
    most = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("pj") - expected) / (most - expected))
    entropy = lambda h: F.log("t") - F.col(h) / F.col("t")
    information = entropy("ha") + entropy("hb") - entropy("hj")
    mean = (entropy("ha") + entropy("hb")) / 2
    return table.select(ari.alias("ari"), F.when(mean == 0, 1.0).otherwise(information / mean).alias("nmi"))


def delong(rows: DataFrame, label: str, score_a: str, score_b: str) -> DataFrame:
    """Two AUROCs on one outcome and the variance of their difference, by midranks; z and two-sided p."""
    rows = rows.select(F.monotonically_increasing_id().alias("__id"), (F.col(label) == 1).cast("int").alias("y"), F.col(score_a).alias("sa"), F.col(score_b).alias("sb"))
    rows = base = written(rows, "delong")
    for s in ("sa", "sb"):
        rows = spread_midranks(spread_midranks(rows, [], s, f"z_{s}", base), ["y"], s, f"x_{s}", base)
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m, n = size.get(1, 0), size.get(0, 0)
    if not m or not n:
        return rows.sparkSession.createDataFrame([(None,) * 4], "auroc_a double, auroc_b double, z double, p double")
    for s in ("sa", "sb"):
        gap = F.col(f"z_{s}") - F.col(f"x_{s}")
        rows = rows.withColumn(f"v_{s}", F.when(F.col("y") == 1, gap / n).otherwise(1 - gap / m))
    by = rows.groupBy("y").agg(F.avg("v_sa").alias("a"), F.avg("v_sb").alias("b"), F.var_samp("v_sa").alias("va"), F.var_samp("v_sb").alias("vb"), F.covar_samp("v_sa", "v_sb").alias("c"))
    spread = (F.col("va") + F.col("vb") - 2 * F.col("c")) / F.when(F.col("y") == 1, m).otherwise(n)
    out = by.agg(F.max(F.when(F.col("y") == 1, F.col("a"))).alias("auroc_a"), F.max(F.when(F.col("y") == 1, F.col("b"))).alias("auroc_b"), F.sum(spread).alias("v"))
    z = F.when(F.col("v") > 0, (F.col("auroc_a") - F.col("auroc_b")) / F.sqrt("v")).otherwise(0.0)
    return out.select("auroc_a", "auroc_b", z.alias("z")).withColumn("p", normal_two_sided("z"))


def _grouped(rows: DataFrame, keys: list[str], columns: list[str], schema: str, work: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*table[keys].iloc[0], *work(table.sort_values(columns)))], columns=[*keys, *names])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, *columns).groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def _interval(estimate: float, draws: list[float], alpha: float) -> tuple[float, float, float]:
    kept = [d for d in draws if d == d]
    if not kept:
        return estimate, float("nan"), float("nan")
    return estimate, float(np.quantile(kept, alpha / 2)), float(np.quantile(kept, 1 - alpha / 2))


def bootstrap(rows: DataFrame, keys: list[str], value: str, statistic: Callable = np.mean, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of a statistic for each group (groups of method-level summaries, which are small)."""

    def work(table: pd.DataFrame) -> tuple:
        x, rng = table[value].to_numpy(float), np.random.default_rng(seed)
        return _interval(float(statistic(x)), [float(statistic(x[rng.integers(0, len(x), len(x))])) for _ in range(draws)], alpha)

    return _grouped(rows.where(F.col(value).isNotNull()), keys, [value], "estimate double, lo double, hi double", work)


def bootstrap_correlation(rows: DataFrame, keys: list[str], x: str, y: str, ranks: bool = False, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Pearson's r (or Spearman's rho) with a paired bootstrap; draws without variance go."""

    def r(a: np.ndarray, b: np.ndarray) -> float:
        if ranks:
            a, b = (pd.Series(v).rank().to_numpy() for v in (a, b))
        return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else float("nan")

    def work(table: pd.DataFrame) -> tuple:
        a, b, rng = table[x].to_numpy(float), table[y].to_numpy(float), np.random.default_rng(seed)
        if len(a) < 3:
            return (float("nan"),) * 3
        picks = [rng.integers(0, len(a), len(a)) for _ in range(draws)]
        return _interval(r(a, b), [r(a[i], b[i]) for i in picks], alpha)

    return _grouped(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y], "estimate double, lo double, hi double", work)


def poisson_bootstrap(rows: DataFrame, keys: list[str], value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Means of ``draws`` resamples for groups of any size: each row counts Poisson(1) times in a draw, and
    the draws' sums are ordinary two-phase aggregates."""
    u = lambda b: (F.pmod(F.xxhash64("__id", b, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        term /= k + 1
        cuts.append(total)
    spread = rows.withColumn("__id", F.monotonically_increasing_id()).select(*keys, value, "__id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weight = sum((u(F.col("draw")) > c).cast("int") for c in cuts)
    spread = spread.withColumn("__w", weight)
    return spread.groupBy(*keys, "draw").agg((F.sum(F.col("__w") * F.col(value)) / F.nullif(F.sum("__w"), F.lit(0))).alias("mean"))


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation (constant columns become zero)."""
    got = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return rows.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - got[f"m_{c}"]) / (got[f"s_{c}"] or 1.0)).alias(c) for c in columns])
