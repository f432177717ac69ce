"""Corpus operators over the driver's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import syntax, variations
from ..dsl.primitives import SIGNATURES
from ..functions import learning, parsing
from ..operators import corpus as C
from ..plans import enumeration

#: A user's ten first values, in buckets, stand for a program's fingerprint; values above 120 are failures.
FP_SQL = """p AS (SELECT event_type AS type, user_id AS ord, list(CASE WHEN value <= 120 THEN CAST(floor(value / 25) AS INT)::VARCHAR END ORDER BY ts, event_id) AS fp FROM
  (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 10 GROUP BY ALL)"""
QUALITY_SQL = """g AS (SELECT *, len(list_filter(fp, lambda v: v IS NOT NULL)) AS ok, len(list_distinct(list_filter(fp, lambda v: v IS NOT NULL))) AS kinds FROM p)"""
KEY_SQL = "array_to_string(list_transform(fp, lambda v: coalesce(v, 'x')), ',')"


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    events = spark.read.parquet(f"{d}/events.parquet")
    k = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    first = events.withColumn("k", k).where("k <= 10").withColumn("v", F.when(F.col("value") <= 120, F.floor(F.col("value") / 25).cast("int").cast("string")))
    rows = first.groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("ord")).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("r"))
    return rows.select("type", "ord", F.transform("r", lambda r: r["v"]).alias("fp"))


def key(fp: str = "fp") -> F.Column:
    return F.array_join(F.transform(fp, lambda v: F.coalesce(v, F.lit("x"))), ",").alias("fp")


def known(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(spark, d).where("ord % 2 = 0")


#: A sketch for each part, by its number; {} is its size.
SKETCHES = ["(λ (x) (take int_hole (drop {} x)))", "(λ (x) (slice int_hole int_hole (cons {} x)))", "(λ (x) (map (λ (y) (+ (* y int_hole) int_hole)) (drop {} x)))", "(λ (x) (append (reverse x) {}))"]
SKETCH_SQL = "CASE " + " ".join(f"WHEN p_partkey % {len(SKETCHES)} = {i} THEN " + "'" + t.replace("{}", "' || p_size || '") + "'" for i, t in enumerate(SKETCHES)) + " END"


def sketches(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet")
    sizes = F.array(*[F.lit(syntax.size(syntax.parse(t.replace("{}", "1")))) for t in SKETCHES])
    return parts.select("p_partkey", F.expr(SKETCH_SQL).alias("program"), F.lit("list[int]").alias("type"), F.get(sizes, F.col("p_partkey") % len(SKETCHES)).alias("size"))


HOLES_SQL = f"h AS (SELECT p_partkey, {SKETCH_SQL} AS sketch, len(regexp_extract_all({SKETCH_SQL}, 'int_hole')) AS n FROM part)"


def expanded_sql(most: int | None) -> str:
    """All fillings, or as many draws where there are more."""
    n = len(C.SEED_CONSTANTS)
    limit = most if most is not None else 1 << 31
    draw = lambda i: f"('0x' || left(md5(concat_ws(':', sketch, place::VARCHAR, '{i}', '0')), 8))::BIGINT % {n}"
    digit = lambda i: f"CASE WHEN {n} ** n <= {limit} THEN (place // ({n} ** (n - 1 - {i}))::BIGINT) % {n} ELSE {draw(i)} END::VARCHAR"
    filled = f"CASE n WHEN 0 THEN sketch WHEN 1 THEN replace(sketch, 'int_hole', {digit(0)}) ELSE regexp_replace(regexp_replace(sketch, 'int_hole', {digit(0)}), 'int_hole', {digit(1)}) END"
    return f"WITH {HOLES_SQL}, e AS (SELECT *, unnest(range(least({n} ** n, {limit})::BIGINT)) AS place FROM h) SELECT p_partkey, {filled} AS program, sketch, place FROM e"


def programs(spark: SparkSession) -> DataFrame:
    """A program for each primitive's templates, applied to the input where the types allow it."""
    texts = []
    for name in SIGNATURES:
        for t in variations.templates(name):
            if t.text.startswith("(λ (a0 a1) (") and SIGNATURES[name] in ("int,[T1]->[T1]", "T1,[T1]->[T1]"):
                texts.append(f"(λ (x) ({syntax.show(variations.draw(t, __import__('random').Random(len(texts))))} 2 x))")
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, program string")


def pools(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("bigint"))).alias("xs"))
    return rows.select("l_orderkey", (F.col("l_orderkey") % 5).alias("g"), F.expr("filter(xs, v -> v > 40)").alias("pool"))


POOLS_SQL = "o AS (SELECT l_orderkey, l_orderkey % 5 AS g, list_filter(list_sort(list(CAST(l_quantity AS BIGINT))), lambda v: v > 40) AS pool FROM lineitem GROUP BY l_orderkey)"
RESPONSES = ["NA", "[]", "C([1, 2])", "7", '[1, "a"]', None, "(1, 2)", "[1.5, -2.5]", "[True, 0]", "-3", "(4)", "5, 6,", "(1.5)", "['8']", "[1 2]"]
RESPONSE_SQL = "CASE event_id % 15 " + " ".join(f"WHEN {i} THEN '" + r.replace("'", "''") + "'" for i, r in enumerate(RESPONSES) if r is not None) + " ELSE '[' || CAST(value AS BIGINT) || ', ' || user_id || ']' END"


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fp_quality": (
        lambda s, d: fingerprints(s, d).select("type", "ord", C.is_non_crashing(F.col("fp")).alias("non_crashing"), C.is_non_constant(F.col("fp")).alias("non_constant"), F.round(C.variability(F.col("fp")), 6).alias("variability"), C.good(F.col("fp")).alias("good")),
        f"""WITH {FP_SQL}, {QUALITY_SQL} SELECT type, ord, ok >= 3 AS non_crashing, kinds >= 2 AS non_constant, CASE WHEN ok <= 1 THEN 0.0 ELSE round(kinds / ok, 6) END AS variability,
        ok >= 3 AND kinds >= 2 AND kinds / ok >= 0.3 AS good FROM g""",
    ),
    "fp_dedup": (
        lambda s, d: C.dedup(fingerprints(s, d), "ord").select("type", "ord", key()),
        f"WITH {FP_SQL} SELECT type, min(ord) AS ord, {KEY_SQL} AS fp FROM p GROUP BY type, fp",
    ),
    "novel_anti": (
        lambda s, d: C.novel(fingerprints(s, d).where("ord % 2 = 1"), known(s, d)).select("type", "ord", key()),
        f"WITH {FP_SQL} SELECT type, ord, {KEY_SQL} AS fp FROM p WHERE ord % 2 = 1 AND {KEY_SQL} NOT IN (SELECT {KEY_SQL} FROM p WHERE ord % 2 = 0)",
    ),
    "reward": (
        lambda s, d: C.with_reward(fingerprints(s, d), known(s, d)).select("type", "ord", F.round("reward", 6).alias("reward")),
        f"""WITH {FP_SQL}, {QUALITY_SQL} SELECT type, ord, CASE WHEN ok >= 3 AND kinds >= 2 THEN round(kinds / ok * CASE WHEN {KEY_SQL} IN (SELECT {KEY_SQL} FROM p WHERE ord % 2 = 0) THEN 0.1 ELSE 1.0 END, 6) ELSE 0.0 END AS reward FROM g""",
    ),
    "topk_reward": (
        lambda s, d: C.top_k(C.with_reward(fingerprints(s, d), known(s, d)).withColumn("who", F.concat_ws(":", F.col("ord").cast("string"), F.col("type"))), 10, "who").select("who", F.round("reward", 6).alias("reward"), key()),
        f"""WITH {FP_SQL}, {QUALITY_SQL}, r AS (SELECT ord || ':' || type AS who, {KEY_SQL} AS fp, CASE WHEN ok >= 3 AND kinds >= 2 THEN kinds / ok * CASE WHEN {KEY_SQL} IN (SELECT {KEY_SQL} FROM p WHERE ord % 2 = 0) THEN 0.1 ELSE 1.0 END ELSE 0.0 END AS reward
        FROM g) SELECT min(who) AS who, round(reward, 6) AS reward, fp FROM r GROUP BY fp, reward ORDER BY reward DESC, who LIMIT 10""",
    ),
    "stratified_pick": (
        lambda s, d: C.stratified(pools(s, d).withColumn("n", F.size("pool")), ["g"], "n", [F.col("l_orderkey")], 3).select("l_orderkey", "g", "n", F.col("quartile").cast("long").alias("quartile")),
        f"""WITH {POOLS_SQL}, q AS (SELECT l_orderkey, g, len(pool)::INT AS n, ntile(4) OVER (PARTITION BY g ORDER BY len(pool), l_orderkey) AS quartile FROM o)
        SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY g, quartile ORDER BY l_orderkey) <= 3""",
    ),
    "io_views": (
        lambda s, d: C.io_views(pools(s, d), 1, 4).select("l_orderkey", "shown", F.array_join("pairs", ",").alias("pairs")),
        f"WITH {POOLS_SQL}, v AS (SELECT l_orderkey, pool, unnest(range(1, least(4, len(pool)) + 1))::INT AS shown FROM o) SELECT l_orderkey, shown, array_to_string(pool[1:shown], ',') AS pairs FROM v",
    ),
    "redirect_empty": (
        lambda s, d: C.redirect_empty(pools(s, d), "l_orderkey", ["g"]).select("l_orderkey", F.array_join("served", ",").alias("served")),
        f"""WITH {POOLS_SQL} SELECT l_orderkey, array_to_string(coalesce(first_value(CASE WHEN len(pool) > 0 THEN pool END IGNORE NULLS) OVER (PARTITION BY g ORDER BY l_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        first_value(CASE WHEN len(pool) > 0 THEN pool END IGNORE NULLS) OVER (PARTITION BY g ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), ',') AS served FROM o""",
    ),
    "histogram": (
        lambda s, d: C.histogram(s.read.parquet(f"{d}/events.parquet"), F.col("value"), 0, 200, 10),
        "SELECT CASE WHEN value >= 200 THEN 11 ELSE floor(value / 20) + 1 END::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL",
    ),
    "quartile_summary": (
        lambda s, d: C.quartile_summary(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value").withColumn("mean", F.round("mean", 6)),
        """WITH k AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY ALL) SELECT event_type, v[1] AS least, v[len(v) // 4 + 1] AS q1, v[2 * len(v) // 4 + 1] AS q2, v[3 * len(v) // 4 + 1] AS q3,
        v[len(v)] AS most, round(list_avg(v), 6) AS mean FROM k""",
    ),
    "survival": (
        lambda s, d: C.survival(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("program"), (F.col("value") > 40).alias("passed"))),
        "SELECT user_id AS program, sum((value > 40)::INT)::BIGINT AS passes, count(*) AS grammars FROM events GROUP BY ALL",
    ),
    "constants_used": (
        lambda s, d: C.constants_used(s.read.parquet(f"{d}/events.parquet").select(F.col("props").alias("program")).select(F.regexp_replace("program", '[{}":]', " ").alias("program"))),
        "SELECT DISTINCT CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS constant FROM events WHERE regexp_matches(props, '\\d')",
    ),
    "parse_response": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", parsing.response(F.expr(RESPONSE_SQL.replace("''", "\\'"))).alias("r")).select("event_id", "r.kind", F.array_join("r.value", ",").alias("value")),
        """SELECT event_id, CASE WHEN event_id % 15 IN (0, 4, 12, 14) THEN 'NO_RESPONSE' WHEN event_id % 15 = 1 THEN 'EMPTY' ELSE 'LIST' END AS kind,
        CASE event_id % 15 WHEN 1 THEN '' WHEN 2 THEN '1,2' WHEN 3 THEN '7' WHEN 5 THEN trunc(value)::BIGINT || ',' || user_id WHEN 6 THEN '1,2' WHEN 7 THEN '1,-2' WHEN 8 THEN '1,0' WHEN 9 THEN '-3' WHEN 10 THEN '4'
        WHEN 11 THEN '5,6' WHEN 13 THEN '8' END AS value FROM events""",
    ),
    "parse_truthy": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", parsing.truthy(F.expr("CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'f' WHEN 2 THEN 'NA' WHEN 3 THEN cast(user_id AS string) ELSE 'what' END")).alias("score")),
        "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 3 THEN user_id::DOUBLE ELSE 0.0 END::DOUBLE AS score FROM events",
    ),
    # All fillings of each sketch. A sketch's first row stands for its others before it is expanded, a text's before it is evaluated:
    # the first row of a behaviour is among these.
    "expand_sketches": (
        lambda s, d: C.dedup(C.evaluate(C.dedup(C.expand(C.dedup(sketches(s, d), "p_partkey", ("type", "program"))), "place", ("type", "program"))).where(C.good(F.col("fp"))), "place", ("type", "fp")).select("program", "type", "size", "place"),
        "",
    ),
    "expand_all": (lambda s, d: C.expand(sketches(s, d)).select("p_partkey", "program", "sketch", "place"), expanded_sql(None)),
    "expand_sampled": (lambda s, d: C.expand(sketches(s, d), most=50).select("p_partkey", "program", "sketch", "place"), expanded_sql(50)),
    "transitions": (lambda s, d: C.transitions(programs(s)), ""),
    "rollouts": (lambda s, d: C.evaluate(C.rollouts(s, 200)), ""),
    "io_samples": (lambda s, d: C.io_samples(programs(s)), ""),
    "enumerate_small": (lambda s, d: enumeration.corpus(enumeration.enumerate_programs(s, 3, only=["+", "take", "reverse", "length", "concat", "map"])), ""),
    "cluster_embeddings": (lambda s, d: learning.cluster(s.read.parquet(f"{d}/embeddings.parquet"), "embedding", [4, 10])[0].select("vec_id", "cluster"), ""),
    "project_embeddings": (lambda s, d: learning.project(s.read.parquet(f"{d}/embeddings.parquet"), "embedding").select("vec_id", "pc1", "pc2"), ""),
    "probe_null": (lambda s, d: learning.probe_null(s.read.parquet(f"{d}/embeddings.parquet").withColumn("y", (F.col("label") < 5).cast("int")), "embedding", "y", "vec_id", 4), ""),
    "probe_auroc": (lambda s, d: learning.probe(s.read.parquet(f"{d}/embeddings.parquet").withColumn("y", (F.col("label") < 5).cast("int")), "embedding", "y", "vec_id"), ""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items() if sql}
