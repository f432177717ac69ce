"""Analytics of trials: who solves which function on which trial, in what order learnt, and how alike answers are.

A trial table has method, function, order, trial (1 to 11), response, correct (0 or 1). Aggregations are
two-phase; windows are partitioned by a sequence, or run over pre-aggregated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIALS, NEVER = 11, 12


def from_events(events: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Trials from an event stream: a type is a method, a user a function, its first events the trials."""
    turn = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    rows = events.select(F.col("event_type").alias("method"), F.col("user_id").alias("function"), turn.alias("trial"), "value", (F.col("value") > threshold).cast("int").alias("correct"))
    return rows.where(F.col("trial") <= TRIALS)


def acquisition(trials: DataFrame, keys: list[str], never: int = NEVER) -> DataFrame:
    """The first place from which all are correct; ``never`` if the last one is wrong. Places are ranks by trial."""
    ranked = trials.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("trial")))
    last_wrong, n = F.max(F.when(F.col("correct") < 1, F.col("place"))), F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(F.when(last_wrong.isNull(), 1).when(last_wrong == n, never).otherwise(last_wrong + 1).alias("acquired_on"))


def complete(trials: DataFrame, keys: list[str], least: int = TRIALS) -> DataFrame:
    """Trials of sequences that are long enough."""
    return trials.join(trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(*keys), keys, "left_semi")


def mean_by(trials: DataFrame, keys: list[str], value: str = "correct", name: str = "accuracy") -> DataFrame:
    return trials.groupBy(*keys).agg(F.avg(value).alias(name))


def per_trial(trials: DataFrame) -> DataFrame:
    """Mean over functions of each function's mean, by method and trial."""
    return mean_by(mean_by(trials, ["method", "trial", "function"]), ["method", "trial"], "accuracy")


def summary(trials: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return trials.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"), F.median(v).alias("median"), F.max(v).alias("most"))


def quantile_by(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Linear interpolation between neighbours."""
    return rows.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("quantile"))


def acquired_share(acquired: DataFrame, group: str, last: int = NEVER) -> DataFrame:
    """Share of a group's functions that are acquired by trial t, for t = 1 to ``last``."""
    spread = acquired.select(group, "acquired_on", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("t"))
    return spread.groupBy(group, "t").agg(F.avg((F.col("acquired_on") <= F.col("t")).cast("int")).alias("share"))


def pivot(rows: DataFrame, index: str, columns: str, values: str, names: list) -> DataFrame:
    """One column per name; names are given, so that no pass is spent on finding them."""
    return rows.groupBy(index).pivot(columns, names).agg(F.first(values))


def pairs(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(a, b, key, value_a, value_b) of every two names a < b on a shared key."""
    left = rows.select(key, F.col(name).alias("a"), F.col(value).alias("value_a"))
    right = rows.select(key, F.col(name).alias("b"), F.col(value).alias("value_b"))
    return left.join(right, key).where("a < b")


def pairwise_correlation(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    return pairs(rows, key, name, value).groupBy("a", "b").agg(F.corr("value_a", "value_b").alias("r"), F.count(F.lit(1)).alias("n"))


def difference_profile(rows: DataFrame, key: str, name: str, value: str, top: int = 10) -> DataFrame:
    """The functions on which two methods differ most, both ways; ties by key."""
    deltas = pairs(rows, key, name, value).withColumn("delta", F.col("value_a") - F.col("value_b"))
    by = Window.partitionBy("a", "b")
    ranked = deltas.withColumn("from_top", F.row_number().over(by.orderBy(F.desc("delta"), key))).withColumn("from_bottom", F.row_number().over(by.orderBy("delta", F.desc(key))))
    return ranked.where((F.col("from_top") <= top) | (F.col("from_bottom") <= top)).select("a", "b", key, "delta", "from_top")


def response_distribution(rows: DataFrame, cell: list[str], response: str = "response") -> DataFrame:
    """Each response's share of its cell."""
    counted = rows.groupBy(*cell, response).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*cell)))


def modal_response(rows: DataFrame, cell: list[str], place: str, response: str = "response") -> DataFrame:
    """The most frequent response of each cell; of equals, the one that was seen first."""
    counted = rows.groupBy(*cell, response).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = counted.groupBy(*cell).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", response)).alias("best"))
    return best.select(*cell, F.col(f"best.{response}").alias("modal"), (-F.col("best.n")).alias("n"))


def thresholded(rows: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("correct").alias("mean_correct"), (F.avg("correct") >= at).cast("int").alias("correct"))


def effort_means(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means of effort columns, blanks left out."""
    return rows.groupBy(*keys).agg(*[F.avg(F.expr(f"try_cast({c} AS double)")).alias(c) for c in columns])


def excluded_subjects(rows: DataFrame, participants: DataFrame | None, most_same: int = 20, least_correct: int = 10, least_seconds: float = 1200) -> DataFrame:
    """Subjects with one response ``most_same`` times or more, ``least_correct`` or fewer correct, or too
    little time (a subject without a participant row has none)."""
    per = rows.groupBy("subject", "response").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"))
    per = per.groupBy("subject").agg(F.max("n").alias("same"), F.sum("c").alias("right"))
    if participants is not None:
        per = per.join(participants.groupBy("subject").agg(F.last("total_time_s").alias("seconds")), "subject", "left")
    else:
        per = per.withColumn("seconds", F.lit(None).cast("double"))
    seconds = F.coalesce(F.col("seconds").try_cast("double"), F.lit(0.0))
    return per.where((F.col("same") >= most_same) | (F.col("right") <= least_correct) | (seconds < least_seconds)).select("subject")


def exclude(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded, "subject", "left_anti")


def error_similarity(methods: DataFrame, humans: DataFrame, cell: list[str]) -> DataFrame:
    """How often people give a method's answer: p_human of each (method, cell); unseen answers have 0.
    An empty answer and a missing one are different answers (``response`` is text that tells them apart)."""
    shares = response_distribution(humans, cell).withColumnRenamed("p", "p_human").drop("n")
    total = humans.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_humans"))
    out = methods.join(shares, [*cell, "response"], "left").join(total, cell, "left")
    return out.withColumn("p_human", F.coalesce("p_human", F.lit(0.0))).withColumn("n_humans", F.coalesce("n_humans", F.lit(1)))


def conditional_means(cells: DataFrame, key: str = "method") -> DataFrame:
    """Mean p_human where the method is right and where it is wrong, 0 where there is no such cell."""
    right = F.col("correct") >= 0.5
    return cells.groupBy(key).agg(
        F.coalesce(F.avg(F.when(right, F.col("p_human"))), F.lit(0.0)).alias("cond_correct"),
        F.coalesce(F.avg(F.when(~right, F.col("p_human"))), F.lit(0.0)).alias("cond_incorrect"),
    )


def feature_rows(per_task: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Long form of the left join of accuracies with boolean features: (method, function, accuracy, feature, value)."""
    joined = per_task.join(features, "function", "left")
    pairs_sql = ", ".join(f"'{n}', {n}" for n in names)
    return joined.select("method", "function", "accuracy", F.expr(f"stack({len(names)}, {pairs_sql}) AS (feature, value)"))


def feature_accuracy(long: DataFrame) -> DataFrame:
    return long.groupBy("method", "feature", "value").agg(F.avg("accuracy").alias("mean"), F.count(F.lit(1)).alias("n"))


def contingency(long: DataFrame, at: float = 0.5) -> DataFrame:
    """Counts of right and wrong (accuracy from ``at`` on) with and without each feature."""
    hit, has = F.col("accuracy") >= at, F.coalesce(F.col("value"), F.lit(False))
    count = lambda c, name: F.sum(c.cast("int")).alias(name)
    return long.groupBy("method", "feature").agg(count(hit & has, "n11"), count(hit & ~has, "n10"), count(~hit & has, "n01"), count(~hit & ~has, "n00"))


def prefix_examples(pairs_table: DataFrame, keys: list[str], place: str = "trial") -> DataFrame:
    """Each trial with the pairs of all earlier trials of its sequence; the first has none."""
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return pairs_table.withColumn("observed", F.collect_list(F.struct("input", "output")).over(before))


def running_best(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Best value so far and the earliest place that had it."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p"))).over(w)
    return rows.withColumn("best", best["v"]).withColumn("best_at", -best["p"])


def moving_average(rows: DataFrame, keys: list[str], place: str, value: str, width: int) -> DataFrame:
    """Mean of the last ``width`` values; a NULL starts anew and has no mean."""
    w = Window.partitionBy(*keys).orderBy(place)
    run = F.sum(F.col(value).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inner = Window.partitionBy(*keys, "__run").orderBy(place).rowsBetween(-(width - 1), 0)
    return rows.withColumn("__run", run).withColumn("average", F.when(F.col(value).isNotNull(), F.avg(value).over(inner))).drop("__run")


def best_per_group(rows: DataFrame, keys: list[str], score: str, place: str) -> DataFrame:
    """The row of the highest score of each group; of equals the first. One aggregate, no sort of the group."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(score), (-F.col(place)).alias("p"))).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in others])


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def log_bins(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins of log10, closed on the right; the first takes its lower edge too."""
    width = (high - low) / bins
    place = F.ceil((F.log10(value) - low) / width)
    return rows.withColumn("bin", F.greatest(F.least(place, F.lit(bins)), F.lit(1)).cast("int"))


def base_rate(rows: DataFrame, key: str, label: str, least: float = 0.10) -> DataFrame:
    """Labels that are true often enough."""
    return rows.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("rate")).where(F.col("rate") >= least)


def acquired_in(acquired: DataFrame, bundle: DataFrame, keys: list[str], never: int = NEVER) -> DataFrame:
    """Sequences that were acquired and that a bundle of features has; what the bundle has twice counts once."""
    return acquired.where(F.col("acquired_on") < never).join(bundle.select(*keys), keys, "left_semi")


def label_fractions(rows: DataFrame, keys: list[str], tokens: Column, words: list[str]) -> DataFrame:
    """(keys, label, share): which share of each task's rows has each word among its tokens, words that none has included; rows
    without tokens (NULL) count for no word. One aggregate of as many means as words, told apart only after it."""
    share = [F.avg(F.coalesce(multi_hot(tokens, [w]), F.lit(0))) for w in words]
    means = rows.groupBy(*keys).agg(F.array(*[F.struct(F.lit(w).alias("label"), x.alias("share")) for w, x in zip(words, share, strict=True)]).alias("__shares"))
    return means.select(*keys, F.inline("__shares"))


def multi_hot(tokens: Column, vocabulary: list[str]) -> Column:
    """1 if a token list has any of the words, else 0."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(v) for v in vocabulary])).cast("int")
