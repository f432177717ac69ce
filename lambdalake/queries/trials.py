"""Trial analytics and statistics over the events and embeddings tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import learning, stats
from ..operators import trials as T

METHODS = ["click", "error", "purchase", "signup", "view"]
TRIALS_SQL = """t AS (
  SELECT * FROM (SELECT event_type AS method, user_id AS function, value, (value > 40)::INT AS correct,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS trial FROM events) WHERE trial <= 11)"""
TASK_SQL = f"WITH {TRIALS_SQL}, a AS (SELECT method, function, avg(correct) AS accuracy FROM t GROUP BY ALL)"
ACQUIRED_SQL = f"""WITH {TRIALS_SQL}, q AS (SELECT method, function, count(*) AS n, max(trial) FILTER (correct < 1) AS w FROM t GROUP BY ALL),
acq AS (SELECT method, function, CASE WHEN w IS NULL THEN 1 WHEN w = n THEN 12 ELSE w + 1 END AS acquired_on FROM q)"""
#: A response is the value's bucket; a cell is a method and trial, users are the subjects.
RESPONSES_SQL = f"WITH {TRIALS_SQL}, r AS (SELECT method, function, trial, correct, floor(least(value, 99) / 20)::INT::VARCHAR AS response FROM t)"
FEATURES = ["even", "low", "third"]
FEATURES_SQL = "f AS (SELECT DISTINCT user_id AS function, user_id % 2 = 0 AS even, user_id < 40 AS low, user_id % 3 = 0 AS third FROM events)"
LONG_SQL = f"""{TASK_SQL}, {FEATURES_SQL}, l AS (SELECT method, a.function, accuracy, 'even' AS feature, even AS value FROM a LEFT JOIN f USING (function)
UNION ALL SELECT method, a.function, accuracy, 'low', low FROM a LEFT JOIN f USING (function)
UNION ALL SELECT method, a.function, accuracy, 'third', third FROM a LEFT JOIN f USING (function))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def trial_table(spark: SparkSession, d: str) -> DataFrame:
    return T.from_events(events(spark, d))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return T.mean_by(trial_table(spark, d), ["method", "function"])


def responses(spark: SparkSession, d: str) -> DataFrame:
    return trial_table(spark, d).withColumn("response", F.floor(F.least("value", F.lit(99)) / 20).cast("int").cast("string"))


def features(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("function")
    return events(spark, d).select(F.col("user_id").alias("function")).distinct().select("function", (u % 2 == 0).alias("even"), (u < 40).alias("low"), (u % 3 == 0).alias("third"))


def long_features(spark: SparkSession, d: str) -> DataFrame:
    return T.feature_rows(tasks(spark, d), features(spark, d), FEATURES)


def acquired(spark: SparkSession, d: str) -> DataFrame:
    return T.acquisition(trial_table(spark, d), ["method", "function"])


def acquired_customers(spark: SparkSession, d: str) -> DataFrame:
    """Acquired sequences of users who are customers, with words about the customer."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("function"), F.array("c_mktsegment", F.when(F.col("c_acctbal") < 0, "DEBT").otherwise("CREDIT")).alias("tokens"))
    return T.acquired_in(acquired(spark, d), customers, ["function"]).join(customers, "function")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "DEBT", "CREDIT"]


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def error_cells(spark: SparkSession, d: str) -> DataFrame:
    """Even users are people, odd ones methods' runs."""
    r = responses(spark, d)
    cell = ["method", "trial"]
    mine = r.where("function % 2 = 1").select(*cell, "function", "response", "correct")
    return T.error_similarity(mine, r.where("function % 2 = 0").select(*cell, "response"), cell)


ERROR_SQL = f"""{RESPONSES_SQL}, h AS (SELECT method, trial, response, count(*) AS n, sum(count(*)) OVER (PARTITION BY method, trial) AS total FROM r WHERE function % 2 = 0 GROUP BY 1, 2, 3),
e AS (SELECT m.*, coalesce(h.n / h.total, 0.0) AS p_human FROM (SELECT * FROM r WHERE function % 2 = 1) m LEFT JOIN h USING (method, trial, response))"""


def with_p(spark: SparkSession, d: str) -> DataFrame:
    """A table of p-values: each task's accuracy, distinct by task."""
    return tasks(spark, d).select("method", "function", F.round(F.greatest("accuracy", F.lit(0.001)) * (F.col("function") + 1) / 1000, 9).alias("p"))


def two_sided_sql(z: str) -> str:
    """Chance of a standard normal beyond z on either side, by Simpson's rule in a thousand steps."""
    weight = "CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0, 1 - sqrt(2 / pi()) * {z} / 3000 * list_sum(list_transform(range(1001), lambda i: {weight} * exp(-1 * pow({z} * i / 1000, 2) / 2))))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "lang")
    return spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id")


LABELLED_SQL = "WITH l AS (SELECT * FROM labels JOIN (SELECT doc_id, n_chars, lang FROM documents) USING (doc_id))"


def clusters(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    signs = sum(((e[i] > 0).cast("int") * (1 << i)) for i in range(3))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", signs.alias("cluster"))


CLUSTERS_SQL = "c AS (SELECT vec_id, label, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + 4 * (embedding[3] > 0)::INT AS cluster FROM embeddings)"


def examples(spark: SparkSession, d: str) -> DataFrame:
    t = trial_table(spark, d).select("method", "function", "trial", F.round("value").cast("long").alias("input"), F.col("correct").cast("long").alias("output"))
    return T.prefix_examples(t, ["method", "function"]).select("method", "function", "trial", F.to_json(F.transform("observed", lambda p: F.array(p["input"], p["output"]))).alias("observed"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Values with gaps: every value above 100 is missing."""
    return trial_table(spark, d).select("method", "function", "trial", F.when(F.col("value") <= 100, F.col("value")).alias("value"))


def excluded(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d).select(F.col("function").alias("subject"), "response", "correct")
    time = events(spark, d).groupBy(F.col("user_id").alias("subject")).agg(F.sum("value").alias("total_time_s"))
    return T.excluded_subjects(r, time, most_same=20, least_correct=10, least_seconds=1200)


def logrank_rows(spark: SparkSession, d: str) -> DataFrame:
    return acquired(spark, d).select("method", "acquired_on", (F.col("acquired_on") < 12).cast("int").alias("event"), (F.col("function") % 2).cast("int").alias("side"))


def _corr(a: str, b: str) -> str:
    return f"((avg({a} * {b}) - avg({a}) * avg({b})) / (stddev_pop({a}) * stddev_pop({b})))"


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "acquisition_trial": (acquired, f"{ACQUIRED_SQL} SELECT * FROM acq"),
    "complete_sequences": (
        lambda s, d: T.complete(trial_table(s, d), ["method", "function"]).groupBy("method").agg(F.countDistinct("function").alias("functions"), F.count(F.lit(1)).alias("trials")),
        f"WITH {TRIALS_SQL} SELECT method, count(DISTINCT function) AS functions, count(*) AS trials FROM t WHERE (method, function) IN (SELECT (method, function) FROM t GROUP BY method, function HAVING count(*) >= 11) GROUP BY method",
    ),
    "per_trial_mean": (
        lambda s, d: rounded(T.per_trial(trial_table(s, d)), "accuracy"),
        f"WITH {TRIALS_SQL}, a AS (SELECT method, trial, function, avg(correct) AS x FROM t GROUP BY ALL) SELECT method, trial, round(avg(x), 6) AS accuracy FROM a GROUP BY ALL",
    ),
    "trial_summary": (
        lambda s, d: rounded(T.summary(trial_table(s, d), ["method", "trial"], "value"), "mean", "sd", "median", "most", places=4),
        f"WITH {TRIALS_SQL} SELECT method, trial, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(value) AS n, round(median(value), 4) AS median, round(max(value), 4) AS most FROM t GROUP BY ALL",
    ),
    "quantile_by_method": (
        lambda s, d: rounded(T.quantile_by(trial_table(s, d), ["method"], "value", 0.25), "quantile"),
        f"WITH {TRIALS_SQL} SELECT method, round(quantile_cont(value, 0.25), 6) AS quantile FROM t GROUP BY ALL",
    ),
    "acquired_share": (
        lambda s, d: rounded(T.acquired_share(acquired(s, d), "method"), "share"),
        f"{ACQUIRED_SQL} SELECT method, x::INT AS t, round(avg((acquired_on <= x)::INT), 6) AS share FROM acq, range(1, 13) r(x) GROUP BY ALL",
    ),
    "label_fractions": (
        lambda s, d: rounded(T.label_fractions(acquired_customers(s, d), ["method"], F.col("tokens"), SEGMENTS), "share"),
        f"""{ACQUIRED_SQL}, c AS (SELECT method, [c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE 'CREDIT' END] AS tokens FROM acq JOIN customer ON function = c_custkey WHERE acquired_on < 12)
        SELECT method, label, round(avg(list_contains(tokens, label)::INT), 6) AS share FROM c, unnest({SEGMENTS}) w(label) GROUP BY ALL""",
    ),
    "difficulty_profile_pivot": (
        lambda s, d: rounded(T.pivot(tasks(s, d), "function", "method", "accuracy", METHODS), *METHODS),
        TASK_SQL + " SELECT function, " + ", ".join(f"round(max(accuracy) FILTER (method = '{m}'), 6) AS {m}" for m in METHODS) + " FROM a GROUP BY function",
    ),
    "pairwise_pearson": (
        lambda s, d: rounded(T.pairwise_correlation(tasks(s, d), "function", "method", "accuracy"), "r"),
        f"{TASK_SQL} SELECT x.method AS a, y.method AS b, round(corr(x.accuracy, y.accuracy), 6) AS r, count(*) AS n FROM a x JOIN a y USING (function) WHERE x.method < y.method GROUP BY ALL",
    ),
    "difference_profile": (
        lambda s, d: rounded(T.difference_profile(tasks(s, d), "function", "method", "accuracy", 5), "delta"),
        f"""{TASK_SQL}, p AS (SELECT x.method AS a, y.method AS b, function, x.accuracy - y.accuracy AS delta FROM a x JOIN a y USING (function) WHERE x.method < y.method),
        k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY delta DESC, function) AS from_top, row_number() OVER (PARTITION BY a, b ORDER BY delta, function DESC) AS from_bottom FROM p)
        SELECT a, b, function, round(delta, 6) AS delta, from_top FROM k WHERE from_top <= 5 OR from_bottom <= 5""",
    ),
    "response_distribution": (
        lambda s, d: rounded(T.response_distribution(responses(s, d), ["method", "trial"]), "p"),
        f"{RESPONSES_SQL} SELECT method, trial, response, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY method, trial), 6) AS p FROM r GROUP BY method, trial, response",
    ),
    "modal_response": (
        lambda s, d: T.modal_response(responses(s, d), ["method", "trial"], "function"),
        f"""{RESPONSES_SQL}, c AS (SELECT method, trial, response, count(*) AS n, min(function) AS f FROM r GROUP BY ALL)
        SELECT method, trial, response AS modal, n FROM c QUALIFY row_number() OVER (PARTITION BY method, trial ORDER BY n DESC, f, response) = 1""",
    ),
    "thresholded_correct": (
        lambda s, d: rounded(T.thresholded(trial_table(s, d), ["method", "function"]), "mean_correct"),
        f"WITH {TRIALS_SQL} SELECT method, function, round(avg(correct), 6) AS mean_correct, (avg(correct) >= 0.5)::INT AS correct FROM t GROUP BY ALL",
    ),
    "effort_means": (
        lambda s, d: rounded(T.effort_means(events(s, d).select("event_type", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("value").cast("string")).alias("cpu")), ["event_type"], ["cpu"]), "cpu"),
        "SELECT event_type, round(avg(value) FILTER (event_id % 5 <> 0), 6) AS cpu FROM events GROUP BY ALL",
    ),
    "subject_exclusion": (
        excluded,
        f"""{RESPONSES_SQL}, c AS (SELECT function AS subject, response, count(*) AS n, sum(correct) AS c FROM r GROUP BY ALL), p AS (SELECT subject, max(n) AS same, sum(c) AS good FROM c GROUP BY ALL),
        s AS (SELECT user_id AS subject, sum(value) AS seconds FROM events GROUP BY ALL) SELECT subject FROM p LEFT JOIN s USING (subject) WHERE same >= 20 OR good <= 10 OR coalesce(seconds, 0) < 1200""",
    ),
    "remaining_responses": (
        lambda s, d: T.exclude(responses(s, d).withColumnRenamed("function", "subject"), excluded(s, d).withColumn("subject", F.col("subject") + 0)).groupBy("method").agg(F.count(F.lit(1)).alias("n")),
        f"""{RESPONSES_SQL}, c AS (SELECT function AS subject, response, count(*) AS n, sum(correct) AS c FROM r GROUP BY ALL), p AS (SELECT subject, max(n) AS same, sum(c) AS good FROM c GROUP BY ALL),
        s AS (SELECT user_id AS subject, sum(value) AS seconds FROM events GROUP BY ALL), x AS (SELECT subject FROM p LEFT JOIN s USING (subject) WHERE same >= 20 OR good <= 10 OR coalesce(seconds, 0) < 1200)
        SELECT method, count(*) AS n FROM r WHERE function NOT IN (SELECT subject FROM x) GROUP BY ALL""",
    ),
    "error_similarity": (
        lambda s, d: rounded(error_cells(s, d).select("method", "trial", "function", "response", "p_human"), "p_human"),
        f"{ERROR_SQL} SELECT method, trial, function, response, round(p_human, 6) AS p_human FROM e",
    ),
    "conditional_means": (
        lambda s, d: rounded(T.conditional_means(error_cells(s, d)), "cond_correct", "cond_incorrect"),
        f"{ERROR_SQL} SELECT method, round(coalesce(avg(p_human) FILTER (correct = 1), 0), 6) AS cond_correct, round(coalesce(avg(p_human) FILTER (correct = 0), 0), 6) AS cond_incorrect FROM e GROUP BY ALL",
    ),
    "feature_accuracy": (
        lambda s, d: rounded(T.feature_accuracy(long_features(s, d)), "mean"),
        f"{LONG_SQL} SELECT method, feature, value, round(avg(accuracy), 6) AS mean, count(*) AS n FROM l GROUP BY ALL",
    ),
    "chi2_counts": (
        lambda s, d: rounded(stats.chi2_p(T.contingency(long_features(s, d))).drop("p"), "chi2"),
        f"""{LONG_SQL}, k AS (SELECT method, feature, sum((accuracy >= 0.5 AND value)::INT)::BIGINT AS n11, sum((accuracy >= 0.5 AND NOT value)::INT)::BIGINT AS n10,
        sum((accuracy < 0.5 AND value)::INT)::BIGINT AS n01, sum((accuracy < 0.5 AND NOT value)::INT)::BIGINT AS n00 FROM l GROUP BY ALL)
        SELECT *, CASE WHEN (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00) > 0 THEN round((n11 + n10 + n01 + n00)::DOUBLE * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01)
          / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 6) END AS chi2 FROM k""",
    ),
    "chi2_p_fdr": (
        lambda s, d: rounded(stats.bh_qvalues(stats.chi2_p(T.contingency(long_features(s, d))), ["method"], "p", "feature"), "chi2", "p", "q"),
        f"""{LONG_SQL}, k AS (SELECT method, feature, sum((accuracy >= 0.5 AND value)::INT)::BIGINT AS n11, sum((accuracy >= 0.5 AND NOT value)::INT)::BIGINT AS n10,
        sum((accuracy < 0.5 AND value)::INT)::BIGINT AS n01, sum((accuracy < 0.5 AND NOT value)::INT)::BIGINT AS n00 FROM l GROUP BY ALL),
        c AS (SELECT *, CASE WHEN (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00) > 0 THEN (n11 + n10 + n01 + n00)::DOUBLE * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01)
          / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)) END AS chi2 FROM k), p AS (SELECT *, CASE WHEN chi2 IS NULL THEN 1.0 ELSE {two_sided_sql("sqrt(chi2)")} END AS p FROM c),
        s AS (SELECT *, p * count(*) OVER (PARTITION BY method) / row_number() OVER (PARTITION BY method ORDER BY p, feature) AS s FROM p)
        SELECT method, feature, n11, n10, n01, n00, round(chi2, 6) AS chi2, round(p, 6) AS p, round(least(1, min(s) OVER (PARTITION BY method ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM s""",
    ),
    "bh_qvalues": (
        lambda s, d: rounded(stats.bh_qvalues(with_p(s, d), ["method"], "p", "function"), "p", "q"),
        f"""{TASK_SQL}, p AS (SELECT method, function, round(greatest(accuracy, 0.001) * (function + 1) / 1000, 9) AS p FROM a),
        s AS (SELECT *, p * count(*) OVER (PARTITION BY method) / row_number() OVER (PARTITION BY method ORDER BY p, function) AS s FROM p)
        SELECT method, function, round(p, 6) AS p, round(least(1, min(s) OVER (PARTITION BY method ORDER BY p, function ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM s""",
    ),
    "midrank": (
        lambda s, d: stats.midranks(tasks(s, d).withColumn("accuracy", F.round("accuracy", 6)), ["method"], "accuracy").select("method", "function", "rank"),
        f"{TASK_SQL} SELECT method, function, rank() OVER (PARTITION BY method ORDER BY round(accuracy, 6)) + (count(*) OVER (PARTITION BY method, round(accuracy, 6)) - 1) / 2 AS rank FROM a",
    ),
    "moving_average_reset": (
        lambda s, d: rounded(T.moving_average(gaps(s, d), ["method", "function"], "trial", "value", 3), "average"),
        f"""WITH {TRIALS_SQL}, g AS (SELECT method, function, trial, CASE WHEN value <= 100 THEN value END AS value FROM t),
        n AS (SELECT *, sum((value IS NULL)::INT) OVER (PARTITION BY method, function ORDER BY trial) AS run FROM g)
        SELECT method, function, trial, value, CASE WHEN value IS NOT NULL THEN round(avg(value) OVER (PARTITION BY method, function, run ORDER BY trial ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS average FROM n""",
    ),
    "running_best": (
        lambda s, d: T.running_best(trial_table(s, d), ["method", "function"], "trial", "value").select("method", "function", "trial", "best", "best_at"),
        f"""WITH {TRIALS_SQL}, b AS (SELECT method, function, trial, value, max(value) OVER w AS best FROM t WINDOW w AS (PARTITION BY method, function ORDER BY trial))
        SELECT b.method, b.function, b.trial, b.best, (SELECT min(x.trial) FROM t x WHERE x.method = b.method AND x.function = b.function AND x.value = b.best AND x.trial <= b.trial) AS best_at FROM b""",
    ),
    "best_run_row": (
        lambda s, d: T.best_per_group(trial_table(s, d).select("method", "function", "trial", "value"), ["method"], "value", "function"),
        f"WITH {TRIALS_SQL} SELECT method, function, trial, value FROM t QUALIFY row_number() OVER (PARTITION BY method ORDER BY value DESC, function, trial) = 1",
    ),
    "top_features": (
        lambda s, d: T.top_n(tasks(s, d).withColumn("accuracy", F.round("accuracy", 6)), ["method"], [F.desc("accuracy"), F.col("function")], 3).withColumn("rank", F.col("rank").cast("long")),
        f"{TASK_SQL}, k AS (SELECT method, function, round(accuracy, 6) AS accuracy FROM a) SELECT *, row_number() OVER (PARTITION BY method ORDER BY accuracy DESC, function) AS rank FROM k QUALIFY rank <= 3",
    ),
    "log_bins": (
        lambda s, d: T.log_bins(events(s, d).where("value >= 0.1"), "value", -1.0, 3.0, 8).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean")),
        "SELECT greatest(least(ceil((log10(value) + 1) / 0.5), 8), 1)::INT AS bin, count(*) AS n, round(avg(value), 5) AS mean FROM events WHERE value >= 0.1 GROUP BY ALL",
    ),
    "base_rate_filter": (
        lambda s, d: rounded(T.base_rate(labelled(s, d), "lang", "toxic", 0.10), "rate"),
        f"{LABELLED_SQL} SELECT lang, round(avg(toxic), 6) AS rate FROM l GROUP BY lang HAVING avg(toxic) >= 0.10",
    ),
    "multi_hot": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.multi_hot(F.split(F.lower("text"), " "), ["the", "de"]).alias("hot")),
        "SELECT doc_id, list_has_any(string_split(lower(text), ' '), ['the', 'de'])::INT AS hot FROM documents",
    ),
    "prefix_examples": (
        examples,
        f"""WITH {TRIALS_SQL} SELECT method, function, trial, '[' || coalesce(array_to_string(list('[' || round(value)::BIGINT || ',' || correct || ']') OVER (PARTITION BY method, function ORDER BY trial
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ','), '') || ']' AS observed FROM t""",
    ),
    "spearman": (
        lambda s, d: rounded(stats.spearman(trial_table(s, d), ["method"], "trial", "value"), "rho"),
        f"""WITH {TRIALS_SQL}, k AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY trial) + (count(*) OVER (PARTITION BY method, trial) - 1) / 2 AS x,
        rank() OVER (PARTITION BY method ORDER BY value) + (count(*) OVER (PARTITION BY method, value) - 1) / 2 AS y FROM t) SELECT method, round(corr(x, y), 6) AS rho FROM k GROUP BY ALL""",
    ),
    "pearson": (
        lambda s, d: rounded(stats.pearson(trial_table(s, d), ["method"], "trial", "value"), "r"),
        f"WITH {TRIALS_SQL} SELECT method, round(corr(trial, value), 6) AS r FROM t GROUP BY ALL",
    ),
    "signed_rank": (
        lambda s, d: stats.signed_rank(T.pairs(tasks(s, d).withColumn("accuracy", F.round("accuracy", 6)), "function", "method", "accuracy").withColumns({"value_a": F.col("value_a") * 1000000, "value_b": F.round(F.col("value_b") * 1000000)}).withColumn("value_a", F.round("value_a")), ["a", "b"], "value_a", "value_b"),
        f"""{TASK_SQL}, p AS (SELECT x.method AS a, y.method AS b, round(round(x.accuracy, 6) * 1000000) - round(round(y.accuracy, 6) * 1000000) AS d FROM a x JOIN a y USING (function) WHERE x.method < y.method),
        r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS k FROM p WHERE d <> 0)
        SELECT a, b, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS statistic, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "signed_rank_p": (
        lambda s, d: rounded(stats.signed_rank_test(T.pairs(tasks(s, d).withColumn("accuracy", F.round(F.round("accuracy", 6) * 1000000)), "function", "method", "accuracy"), ["a", "b"], "value_a", "value_b"), "p"),
        # The normal form alone: shares of correct trials tie, and the exact form is for rows without ties.
        f"""{TASK_SQL}, p AS (SELECT x.method AS a, y.method AS b, round(round(x.accuracy, 6) * 1000000) - round(round(y.accuracy, 6) * 1000000) AS d FROM a x JOIN a y USING (function) WHERE x.method < y.method),
        r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS k, count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM p WHERE d <> 0),
        g AS (SELECT a, b, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS statistic, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
        z AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS v FROM g),
        y AS (SELECT *, CASE WHEN v > 0 THEN abs(statistic - n * (n + 1) / 4) / sqrt(v) ELSE 0.0 END AS z FROM z)
        SELECT a, b, statistic, n, CASE WHEN v > 0 AND (n > 50 OR ties > 0) THEN round({two_sided_sql("z")}, 6) WHEN v <= 0 THEN 1.0 END AS p FROM y""",
    ),
    "logrank": (
        lambda s, d: rounded(stats.log_rank(logrank_rows(s, d), ["method"], "acquired_on", "event", "side"), "expected", "variance", "chi2"),
        f"""{ACQUIRED_SQL}, x AS (SELECT method, acquired_on AS tm, sum((function % 2 = 0)::INT) AS n0, sum((function % 2 = 1)::INT) AS n1, sum((acquired_on < 12 AND function % 2 = 0)::INT) AS d0, sum((acquired_on < 12)::INT) AS d FROM acq GROUP BY ALL),
        r AS (SELECT method, d0, d, (sum(n0) OVER w)::DOUBLE AS r0, (sum(n1) OVER w)::DOUBLE AS r1 FROM x WINDOW w AS (PARTITION BY method ORDER BY tm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        z AS (SELECT method, sum(d0)::BIGINT AS o, sum(d * r0 / (r0 + r1)) AS e, sum(d * r0 * r1 * (r0 + r1 - d) / ((r0 + r1) * (r0 + r1) * (r0 + r1 - 1))) AS v FROM r WHERE r0 + r1 >= 2 AND d > 0 GROUP BY ALL)
        SELECT method, o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, CASE WHEN v > 0 THEN round((o - e) * (o - e) / v, 6) ELSE 0.0 END AS chi2 FROM z""",
    ),
    "auroc": (
        lambda s, d: rounded(stats.auroc(labelled(s, d), ["lang"], "quality", "n_chars"), "auroc"),
        f"""{LABELLED_SQL}, k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM l),
        g AS (SELECT lang, sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM k GROUP BY ALL)
        SELECT lang, round((rs - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auroc, p AS positives, n AS negatives FROM g""",
    ),
    "ari_nmi": (
        lambda s, d: rounded(stats.agreement(clusters(s, d), "label", "cluster"), "ari", "nmi"),
        f"""WITH {CLUSTERS_SQL}, x AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM c GROUP BY ALL), a AS (SELECT count(*)::DOUBLE AS m FROM c GROUP BY label), b AS (SELECT count(*)::DOUBLE AS m FROM c GROUP BY cluster),
        s AS (SELECT (SELECT sum(n) FROM x) AS t, (SELECT sum(n * (n - 1) / 2) FROM x) AS pj, (SELECT sum(n * ln(n)) FROM x) AS hj, (SELECT sum(m * (m - 1) / 2) FROM a) AS pa, (SELECT sum(m * ln(m)) FROM a) AS ha,
          (SELECT sum(m * (m - 1) / 2) FROM b) AS pb, (SELECT sum(m * ln(m)) FROM b) AS hb)
        SELECT round((pj - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(((ln(t) - ha / t) + (ln(t) - hb / t) - (ln(t) - hj / t)) / (((ln(t) - ha / t) + (ln(t) - hb / t)) / 2), 6) AS nmi FROM s""",
    ),
    "delong": (
        lambda s, d: rounded(stats.delong(labelled(s, d).withColumn("again", F.col("doc_id") % 97), "quality", "n_chars", "again"), "auroc_a", "auroc_b", "z", "p"),
        f"""{LABELLED_SQL}, k AS (SELECT row_number() OVER () AS id, quality = 1 AS y, n_chars AS a, doc_id % 97 AS b FROM l),
        w AS (SELECT i.id AS i, j.id AS j, CASE WHEN i.a > j.a THEN 1.0 WHEN i.a = j.a THEN 0.5 ELSE 0.0 END::DOUBLE AS a, CASE WHEN i.b > j.b THEN 1.0 WHEN i.b = j.b THEN 0.5 ELSE 0.0 END::DOUBLE AS b FROM k i JOIN k j ON i.y AND NOT j.y),
        x AS (SELECT avg(a) AS a, avg(b) AS b FROM w GROUP BY i), y AS (SELECT avg(a) AS a, avg(b) AS b FROM w GROUP BY j),
        v AS (SELECT (SELECT avg(a) FROM w) AS a, (SELECT avg(b) FROM w) AS b, (SELECT (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) FROM x) + (SELECT (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) FROM y) AS v),
        z AS (SELECT *, CASE WHEN v > 0 THEN (a - b) / sqrt(v) ELSE 0.0 END AS z FROM v)
        SELECT round(a, 6) AS auroc_a, round(b, 6) AS auroc_b, round(z, 6) AS z, round({two_sided_sql("abs(z)")}, 6) AS p FROM z""",
    ),
    "conditional_auroc": (
        lambda s, d: rounded(learning.conditional_auroc(labelled(s, d).withColumn("given", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") > 400)), "given", "quality", "n_chars", ["lang"]), "auroc"),
        f"""{LABELLED_SQL}, c AS (SELECT lang, n_chars > 400 AS given, quality, n_chars FROM l WHERE doc_id % 5 > 0),
        k AS (SELECT lang, given, quality, rank() OVER (PARTITION BY lang, given ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, given, n_chars) - 1) / 2 AS r FROM c),
        g AS (SELECT lang, given, sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM k GROUP BY ALL)
        SELECT lang, given, round((rs - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auroc, p AS positives, n AS negatives FROM g""",
    ),
    "bootstrap_ci": (lambda s, d: stats.bootstrap(tasks(s, d), ["method"], "accuracy", draws=500), ""),
    "bootstrap_pearson": (lambda s, d: stats.bootstrap_correlation(tasks(s, d), ["method"], "function", "accuracy", draws=200), ""),
    "poisson_bootstrap": (lambda s, d: stats.poisson_bootstrap(trial_table(s, d), ["method"], "correct", draws=50), ""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items() if sql}
