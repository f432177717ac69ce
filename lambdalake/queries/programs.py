"""Jobs on corpora of programs that are made from the tables: each family of programs is a text with a place for a
constant, and the constants are the different quantities of ``lineitem``. What must come out is told by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import simplification

#: Simplification: (rule, program, simplified). A list stands in (cons {k} .), a number in (cons . x), a truth in (if . (take {k} x) x).
LISTS = [
    ("map-id", "(map (λ (y) y) x)", "_p0"),
    ("filter-true", "(filter (λ (y) true) x)", "_p0"),
    ("filter-false", "(filter (λ (y) false) (concat [] []))", "[]"),
    ("concat-empty-r", "(concat x [])", "_p0"),
    ("concat-empty-l", "(concat [] x)", "_p0"),
    ("map-empty", "(map (λ (y) (+ y {k})) [])", "[]"),
    ("filter-empty", "(filter (λ (y) (> y {k})) [])", "[]"),
    ("rev-rev", "(reverse (reverse x))", "_p0"),
    ("reverse-of-repeat", "(reverse (repeat {k} 3))", "(repeat {k} 3)"),
    ("reverse-empty", "(reverse [])", "[]"),
    ("if-true", "(if true (take {k} x) x)", "(take {k} _p0)"),
    ("if-false", "(if false (take {k} x) x)", "_p0"),
    ("if-same", "(if true (drop {k} x) (drop {k} x))", "(drop {k} _p0)"),
    ("several", "(reverse (concat (map (λ (y) (+ y 0)) (reverse x)) []))", "_p0"),
    ("none", "(take {k} (reverse x))", None),
]
NUMBERS = [
    ("add-zero-r", "(+ {k} 0)", "{k}"),
    ("add-zero-l", "(+ 0 {k})", "{k}"),
    ("mul-one-r", "(* {k} 1)", "{k}"),
    ("mul-one-l", "(* 1 {k})", "{k}"),
    ("sub-zero", "(- {k} 0)", "{k}"),
    ("mul-zero-r", "(* {k} 0)", "0"),
    ("mul-zero-l", "(* 0 {k})", "0"),
    ("length-of-repeat", "(length (repeat 2 {k}))", "{k}"),
    ("product-of-repeat", "(product (repeat 2 3))", "8"),
    ("sum-of-repeat", "(sum (repeat {k} 3))", "{3k}"),
    ("first-of-repeat", "(first (repeat {k} 3))", "{k}"),
    ("length-of-concat", "(length (concat (singleton {k}) x))", "(+ 1 (length _p0))"),
    ("length-of-map", "(length (map (λ (y) (+ y {k})) x))", "(length _p0)"),
    ("length-of-reverse", "(length (reverse x))", "(length _p0)"),
    ("length-of-singleton", "(length (singleton {k}))", "1"),
    ("length-of-cons", "(length (cons {k} []))", "1"),
    ("length-empty", "(length [])", "0"),
    ("sum-empty", "(sum [])", "0"),
    ("product-empty", "(product [])", "1"),
]
TRUTHS = [
    ("not-not", "(not (not (is_even {k})))", "(is_even {k})"),
    ("and-true-r", "(and (> {k} 3) true)", "(> {k} 3)"),
    ("and-true-l", "(and true (> {k} 3))", "(> {k} 3)"),
    ("or-false-r", "(or (> {k} 3) false)", "(> {k} 3)"),
    ("or-false-l", "(or false (> {k} 3))", "(> {k} 3)"),
]
#: Truths that settle a branch; the whole program is given.
SETTLED = [
    ("and-false-r", "(and true false)", "(λ (_p0) _p0)"),
    ("and-false-l", "(and false true)", "(λ (_p0) _p0)"),
    ("or-true-r", "(or false true)", "(λ (_p0) (take {k} _p0))"),
    ("or-true-l", "(or true false)", "(λ (_p0) (take {k} _p0))"),
]


def _families() -> list[tuple[str, str, str]]:
    out = []
    for rows, around in ((LISTS, "(cons {k} .)"), (NUMBERS, "(cons . x)"), (TRUTHS, "(if . (take {k} x) x)")):
        for rule, before, after in rows:
            left = f"(λ (x) {around.replace('.', before)})"
            out.append((rule, left, left if after is None else f"(λ (_p0) {around.replace(' x', ' _p0').replace('.', after)})"))
    return out + [(rule, f"(λ (x) (if {before} (take {{k}} x) x))", after) for rule, before, after in SETTLED]


FAMILIES = _families()
QUANTITIES_SQL = "k AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS k FROM lineitem)"
#: λ and its names are one node, a list one more than its elements, every other name, number and truth is one.
SIZE_SQL = r"len(regexp_extract_all(regexp_replace({p}, '\(λ \([^)]*\)', '(λ', 'g'), '\[|[^\s()\[\]]+'))"
DEPTH_SQL = r"list_max(list_transform(range(1, len({s}) + 1), lambda i: len(regexp_replace({s}[1:i], '[^(]', '', 'g')) - len(regexp_replace({s}[1:i], '[^)]', '', 'g'))))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"f({names}) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)})"


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("k")).distinct()


def with_constant(text: str, k: F.Column) -> F.Column:
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), k.cast("string")), F.lit("{3k}"), (3 * k).cast("string"))


def corpus(spark: SparkSession, d: str, families: list[tuple[str, str, str]] = FAMILIES) -> DataFrame:
    """(rule, k, program): every family with every constant."""
    made = F.array(*[F.struct(F.lit(rule).alias("rule"), with_constant(text, F.col("k")).alias("program")) for rule, text, *_ in families])
    return quantities(spark, d).select("k", F.explode(made).alias("f")).select("f.rule", "k", "f.program")


MADE_SQL = f"""{QUANTITIES_SQL}, {_values(FAMILIES, "rule, before, after")},
m AS (SELECT rule, k, replace(before, '{{k}}', k::VARCHAR) AS program, replace(replace(after, '{{k}}', k::VARCHAR), '{{3k}}', (3 * k)::VARCHAR) AS simple FROM f CROSS JOIN k)"""


def simplified(spark: SparkSession, d: str) -> DataFrame:
    out = simplification.simplify_corpus(corpus(spark, d)).distinct()
    return out.select("original_program", "program", F.col("size").cast("long").alias("size"), F.col("original_size").cast("long").alias("original_size"), F.round("reduction_ratio", 6).alias("reduction_ratio"))


SIMPLIFIED_SQL = f"""WITH {MADE_SQL}, s AS (SELECT DISTINCT program AS original_program, simple AS program, {SIZE_SQL.format(p="simple")} AS size, {SIZE_SQL.format(p="program")} AS original_size FROM m)
SELECT original_program, program, size, original_size, round(1 - size / original_size, 6) AS reduction_ratio FROM s"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    rows = C.measures(corpus(spark, d).select("program").distinct())
    return rows.select("program", F.col("tree_size").cast("long").alias("tree_size"), F.col("depth").cast("long").alias("depth"), F.col("holes").cast("long").alias("holes"), F.array_join("free", ",").alias("free"), "canonical")


#: Of these families only y and x are bound, y within x.
MEASURED_SQL = f"""WITH {MADE_SQL}, s AS (SELECT DISTINCT program, replace(regexp_replace(program, '\\(λ \\([^)]*\\)', '(λ', 'g'), '[]', '') AS bare FROM m)
SELECT program, {SIZE_SQL.format(p="program")} AS tree_size, {DEPTH_SQL.format(s="bare")} AS depth, 0::BIGINT AS holes, '' AS free,
regexp_replace(regexp_replace(program, '\\by\\b', '_p1', 'g'), '\\bx\\b', '_p0', 'g') AS canonical FROM s"""

LEXEMES_SQL = r"regexp_extract_all(program, '(λ|[()\[\]]|\d+|[^\s()\[\]λ]+)')"
VOCABULARY_SQL = "[" + ", ".join(_quoted(w) for w in C.vocabulary()) + "]"
NAMES = {"take": "drop", "drop": "take", "+": "-"}

#: Fingerprints: (family, program, its values on list t of the suite in SQL; NULL is a failure).
VALUED = [
    ("take", "(λ (x) (take {k} x))", "to_json(t[1:k])"),
    ("drop", "(λ (x) (drop {k} x))", "to_json(t[k + 1:])"),
    ("reverse", "(λ (x) (cons {k} (reverse x)))", "to_json(list_concat([k], list_reverse(t)))"),
    ("map", "(λ (x) (map (λ (y) (* y {k})) x))", "to_json(list_transform(t, lambda v: v * k))"),
    ("filter", "(λ (x) (filter (λ (y) (> y {k})) x))", "to_json(list_filter(t, lambda v: v > k))"),
    ("sum", "(λ (x) (+ {k} (sum x)))", "to_json(k + coalesce(list_sum(t), 0)::BIGINT)"),
    ("first", "(λ (x) (* {k} (first x)))", "CASE WHEN len(t) > 0 THEN to_json(k * t[1]) END"),
    ("longer", "(λ (x) (> (length x) {k}))", "to_json(len(t) > k)"),
]
SUITE_SQL = f"suite AS (SELECT unnest({C.TEST_SUITE}::BIGINT[][]) AS t, unnest(range({len(C.TEST_SUITE)})) AS i)"
VALUED_SQL = f"""v AS (SELECT k, i, unnest([{', '.join(f"{{'program': replace({_quoted(text)}, '{{k}}', k::VARCHAR), 'value': {value}::VARCHAR}}" for _, text, value in VALUED)}]) AS p FROM k CROSS JOIN suite),
e AS (SELECT k, p.program AS program, list(p.value ORDER BY i) AS fp FROM v GROUP BY ALL)"""
#: The same for single programs, in native columns.
NATIVE = [
    ("(λ (x) (reverse x))", "to_json(list_reverse(t))"),
    ("(λ (x) (sum x))", "coalesce(list_sum(t), 0)::BIGINT"),
    ("(λ (x) (map (λ (y) (/ 6 y)) x))", "CASE WHEN NOT list_contains(t, 0) THEN to_json(list_transform(t, lambda v: floor(6 / v)::BIGINT)) END"),
]
NATIVE_SQL = f"""v AS (SELECT i, unnest([{', '.join(f"{{'program': {_quoted(text)}, 'value': {value}::VARCHAR}}" for text, value in NATIVE)}]) AS p FROM suite),
e AS (SELECT p.program AS program, list(p.value ORDER BY i) AS fp FROM v GROUP BY ALL)"""
FP_TEXT_SQL = "array_to_string(list_transform(fp, lambda v: coalesce(v, 'x')), ' ')"


def fp_text(fp: str = "fp") -> F.Column:
    return F.array_join(F.transform(fp, lambda v: F.coalesce(v, F.lit("x"))), " ").alias("fp")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(program, inp, out): of each order's quantities the program takes some; two are said to come out."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("inp"))
    return rows.select(F.concat(F.lit("(λ (x) (take "), (F.col("l_orderkey") % 4 + 1).cast("string"), F.lit(" x))")).alias("program"), "inp", F.slice("inp", 1, 2).alias("out"))


PAIRS_SQL = """o AS (SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT))) AS inp FROM lineitem GROUP BY ALL),
p AS (SELECT '(λ (x) (take ' || (l_orderkey % 4 + 1) || ' x))' AS program, l_orderkey % 4 + 1 AS n, inp, inp[1:2] AS out FROM o)"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(state, action) of a policy's steps, from events."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.concat("event_type", F.lit(" | "), (F.col("user_id") % 3).cast("string")).alias("state"), F.concat(F.lit("apply "), F.floor(F.col("value") / 40).cast("string")).alias("action"))


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "simplify_corpus": (simplified, SIMPLIFIED_SQL),
    "program_measures": (measured, MEASURED_SQL),
    "depth_distribution": (
        lambda s, d: C.depth_distribution(corpus(s, d), ["rule"]).select("rule", F.col("depth").cast("long").alias("depth"), "n", F.round("share", 6).alias("share")),
        f"""WITH {MADE_SQL}, b AS (SELECT rule, regexp_replace(translate(replace(regexp_replace(program, '\\(λ \\([^)]*\\)', '(λ', 'g'), '[]', ''), '[]', '()'), '[^()]', '', 'g') AS marks FROM m),
        e AS (SELECT rule, coalesce(list_max(list_transform(range(1, len(marks) + 1), lambda i: 2 * len(replace(marks[1:i], ')', '')) - i)), 0) AS depth FROM b),
        n AS (SELECT rule, depth, count(*) AS n FROM e GROUP BY ALL)
        SELECT rule, depth, n, round(n / sum(n) OVER (PARTITION BY rule), 6) AS share FROM n""",
    ),
    "tokenise": (
        lambda s, d: corpus(s, d).select("program", F.array_join(C.token_ids(F.col("program")), " ").alias("ids")).distinct(),
        f"WITH {MADE_SQL} SELECT DISTINCT program, array_to_string(list_concat([1], list_transform({LEXEMES_SQL}, lambda t: coalesce(list_position({VOCABULARY_SQL}, t) - 1, 3)), [2]), ' ') AS ids FROM m",
    ),
    "shuffle_names": (
        lambda s, d: corpus(s, d).select(F.col("program").alias("original"), C.shuffled(F.col("program"), NAMES).alias("s")).select("original", "s.program", F.array_join("s.preamble", " ").alias("preamble")).distinct(),
        f"""WITH {MADE_SQL}, t AS (SELECT DISTINCT program AS original, list_transform({LEXEMES_SQL}, lambda t: {{'new': CASE t WHEN 'take' THEN 'drop' WHEN 'drop' THEN 'take' WHEN '+' THEN '-' END, 'old': t}}) AS l FROM m)
        SELECT original, array_to_string(list_transform(l, lambda t: coalesce(t.new, t.old)), ' ') AS program,
        array_to_string(list_transform(list_sort(list_distinct(list_filter(l, lambda t: t.new IS NOT NULL))), lambda t: t.new || '=' || t.old), ' ') AS preamble FROM t""",
    ),
    "evaluate_corpus": (
        lambda s, d: C.evaluate(corpus(s, d, VALUED)).select("program", fp_text()),
        f"WITH {QUANTITIES_SQL}, {SUITE_SQL}, {VALUED_SQL} SELECT program, {FP_TEXT_SQL} AS fp FROM e",
    ),
    "evaluated_dedup": (
        lambda s, d: C.dedup(C.evaluate(corpus(s, d, VALUED)).where(C.good(F.col("fp"))).select(F.lit("any").alias("type"), "program", "fp"), "program").select("program", fp_text()),
        f"""WITH {QUANTITIES_SQL}, {SUITE_SQL}, {VALUED_SQL}, g AS (SELECT *, len(list_filter(fp, lambda v: v IS NOT NULL)) AS ok, len(list_distinct(list_filter(fp, lambda v: v IS NOT NULL))) AS kinds FROM e)
        SELECT min(program) AS program, {FP_TEXT_SQL} AS fp FROM g WHERE ok >= 3 AND kinds >= 2 AND kinds / ok >= 0.3 GROUP BY {FP_TEXT_SQL}""",
    ),
    "fingerprint_native": (
        lambda s, d: C.fingerprint_columns(s, [text for text, _ in NATIVE]).select("program", fp_text()),
        f"WITH {SUITE_SQL}, {NATIVE_SQL} SELECT program, {FP_TEXT_SQL} AS fp FROM e",
    ),
    "validation_split": (
        lambda s, d: C.validation_split(corpus(s, d, VALUED)).select("program", "type", F.col("size").cast("long").alias("size"), fp_text()),
        f"""WITH {QUANTITIES_SQL}, {SUITE_SQL}, {VALUED_SQL}, c AS (SELECT *, list_filter(fp, lambda v: v IS NOT NULL) AS ok FROM e)
        SELECT regexp_replace(regexp_replace(program, '\\by\\b', '_p1', 'g'), '\\bx\\b', '_p0', 'g') AS program, 'list[int]' AS type, {SIZE_SQL.format(p="program")} AS size, {FP_TEXT_SQL} AS fp
        FROM c WHERE len(ok) > 0 AND list_bool_and(list_transform(ok, lambda v: v LIKE '[%'))""",
    ),
    "io_check": (
        lambda s, d: C.check(pairs(s, d)),
        f"WITH {PAIRS_SQL} SELECT program, bool_and(list_transform(inp[1:n], lambda v: v % 100) = out) AS \"right\", count(*) AS pairs FROM p GROUP BY ALL",
    ),
    "io_score": (
        lambda s, d: C.io_score(pairs(s, d)).withColumn("score", F.round("score", 6)),
        f"""WITH {PAIRS_SQL}, e AS (SELECT program, var_samp(v) AS ve FROM (SELECT program, unnest(out) AS v FROM p) GROUP BY ALL),
        a AS (SELECT program, coalesce(var_samp(len(out)), 0) AS vl, count(DISTINCT out) / count(*) AS kinds, avg((inp <> out)::INT) AS changed FROM p GROUP BY ALL)
        SELECT program, round(0.25 * (least(vl / 10, 1) + least(coalesce(ve, 0) / 1000, 1) + kinds + changed), 6) AS score FROM a LEFT JOIN e USING (program)""",
    ),
    "count_policy": (
        lambda s, d: C.count_policy(steps(s, d)).select(F.col("tier").cast("long").alias("tier"), "state", "action", "n", F.round("p", 9).alias("p")),
        """WITH s AS (SELECT event_type || ' | ' || (user_id % 3) AS state, event_type AS kind, 'apply ' || floor(value / 40)::BIGINT AS action FROM events),
        t AS (SELECT 0::BIGINT AS tier, state, action FROM s UNION ALL SELECT 1, kind, action FROM s UNION ALL SELECT 2, '', action FROM s), c AS (SELECT tier, state, action, count(*) AS n FROM t GROUP BY ALL)
        SELECT *, round(n / sum(n) OVER (PARTITION BY tier, state), 9) AS p FROM c""",
    ),
    "sample_by_hash": (
        lambda s, d: C.sample(s.read.parquet(f"{d}/events.parquet").select("event_id"), 100, "event_id"),
        "SELECT event_id FROM events ORDER BY md5(event_id || ':0'), event_id LIMIT 100",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items()}
