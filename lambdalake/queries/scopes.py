"""Queries on programs with names in scope, found by enumeration or renamed row by row, over rows of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import syntax
from ..dsl import types as T
from ..dsl.compiler import column
from ..dsl.primitives import get_grammar
from ..functions import parsing
from ..functions.order import shared_dir, spread, written
from ..operators import corpus as C
from ..operators import variants
from ..plans import banks
from ..sources import files, methods

#: (name, term, names in scope); a and b are columns of ``lineitem``.
TERMS = [
    ("scaled", "(+ (* v a) b)", (("v", "int"),)),
    ("quotient", "(/ b (- v a))", (("v", "int"),)),
    ("between", "(and (> b v) (< v w))", (("v", "int"), ("w", "int"))),
    ("joined", "(concat ys (take a x))", (("ys", "list[int]"),)),
    ("within", "(filter (λ (e) (> e v)) (cons a (concat ys x)))", (("v", "int"), ("ys", "list[int]"))),
]


def _list(values: list) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else str(v) for v in values) + "]" + ("" if values else "::BIGINT[]")


TESTS_SQL = f"t AS (SELECT unnest(range(10)) AS i, unnest([{', '.join(_list(x) for x in C.TEST_SUITE)}]) AS x)"
NUMBERS_SQL = f"n AS (SELECT unnest(range(3)) AS j, unnest({C.PROBES['int']}) AS v)"
LISTS_SQL = f"l AS (SELECT unnest(range(3)) AS j, unnest([{', '.join(_list(x) for x in C.PROBES['list[int]'])}]) AS ys)"
TEXT_SQL = "'[' || array_to_string({}, ',') || ']'"


def contextual(spark: SparkSession, d: str) -> DataFrame:
    """Contextual fingerprints of five families of open terms, with two constants of each line in them. They depend on the
    constants alone, so they are worked out once for each different pair, over many tasks, and joined."""
    given = {"a": F.col("l_linenumber").cast("long"), "b": F.col("l_quantity").cast("long")}
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in given.items()])
    given = {k: F.col(k) for k in given}
    joined = [F.array_join(banks.contextual_fingerprint(term, banks.Context(names, 1), {k: v for k, v in given.items() if syntax.uses(syntax.parse(term), k)}), "|", "-").alias(name) for name, term, names in TERMS]
    fingerprints = written(spread(rows.select("a", "b").distinct()).select("a", "b", *joined), "fingerprints")
    return rows.join(fingerprints, ["a", "b"]).select("l_orderkey", "l_linenumber", *[name for name, _, _ in TERMS])


def _contextual_sql() -> str:
    values = [
        ("scaled", "n", "(v * a + b)::VARCHAR", "n.j"),
        ("quotient", "n", "CASE WHEN v <> a THEN floor(b / (v - a)::DOUBLE)::BIGINT::VARCHAR END", "n.j"),
        ("between", "n CROSS JOIN (SELECT j AS k, v AS w FROM n)", "(b > v AND v < w)::VARCHAR", "n.j, k"),
        ("joined", "l", TEXT_SQL.format("list_concat(ys, x[1:a])"), "l.j"),
        ("within", "n CROSS JOIN (SELECT j AS k, ys FROM l)", TEXT_SQL.format("list_filter(list_concat([a], ys, x), lambda e: e > v)"), "n.j, k"),
    ]
    # Each family depends on (a, b) alone, so it is worked out once for each.
    parts = [f"{name} AS (SELECT a, b, string_agg(coalesce({value}, '-'), '|' ORDER BY t.i, {order}) AS {name} FROM p CROSS JOIN t CROSS JOIN {probes} GROUP BY a, b)" for name, probes, value, order in values]
    p = "p AS (SELECT DISTINCT l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b FROM lineitem)"
    names = [v[0] for v in values]
    joins = " ".join(f"JOIN {n} USING (a, b)" for n in names)
    return f"WITH {TESTS_SQL}, {NUMBERS_SQL}, {LISTS_SQL}, {p}, {', '.join(parts)} SELECT l_orderkey, l_linenumber, {', '.join(names)} FROM (SELECT *, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b FROM lineitem) {joins}"


def enumerated(spark: SparkSession, d: str) -> DataFrame:
    """Every program that enumeration finds up to size five, bodies of functions included, on the quantities of all orders."""
    found = banks.Enumerator(spark, f"{shared_dir(spark)}/bank-{uuid.uuid4().hex}", only=["length", "map"]).bank(5)
    orders = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("xs"))
    values = []
    for r in sorted(found.select("program", "type").collect()):
        node = syntax.fill(syntax.Lam(("x",), syntax.parse(r.program)), C.HOLE_PROBES)
        value = column(node, "xs", types=[T.ListOf(T.INT)])
        empty = F.array().cast(r.type.replace("list[", "array<").replace("]", ">").replace("int", "bigint").replace("bool", "boolean")) if r.program == "[]" else value
        values.append((r.program, r.type, banks.value_text(empty)))
    # A column for each program, summed up as orders pass: a row for each program and order would have to be sorted, texts and all.
    wide = orders.select(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(values)])
    sums = [F.struct(F.count(f"v{i}").alias("n"), F.sum(F.length(f"v{i}")).alias("chars"), F.min(f"v{i}").alias("least"), F.max(f"v{i}").alias("most")).alias(f"s{i}") for i in range(len(values))]
    one = wide.agg(F.count(F.lit(1)).alias("orders"), *sums).where("orders > 0")
    rows = F.array(*[F.struct(F.lit(p).alias("program"), F.lit(t).alias("type"), F.col(f"s{i}").alias("s")) for i, (p, t, _) in enumerate(values)])
    return one.select(F.explode(rows).alias("r")).select("r.program", "r.type", "r.s.*")


def _enumerated_sql() -> str:
    each = lambda value: f"'[' || array_to_string(list_transform(xs, lambda e: {value}), ',') || ']'"
    hole = C.HOLE_PROBES[0]
    whole = TEXT_SQL.format("xs")
    programs = [
        ("true", "bool", "'true'"), ("false", "bool", "'false'"), ("int_hole", "int", f"'{hole}'"), ("x", "list[int]", whole),
        *[("[]", k, "'[]'") for k in ("list[int]", "list[bool]", "list[list[int]]")],
        ("(length x)", "int", "len(xs)::VARCHAR"), ("(length [])", "int", "'0'"),
        ("(map (λ (_p0) true) x)", "list[bool]", each("'true'")), ("(map (λ (_p0) false) x)", "list[bool]", each("'false'")),
        ("(map (λ (_p0) int_hole) x)", "list[int]", each(f"'{hole}'")), ("(map (λ (_p0) []) x)", "list[list[int]]", each("'[]'")),
        ("(map (λ (_p0) x) x)", "list[list[int]]", each(whole)),
        ("(map (λ (_p0) (length x)) x)", "list[int]", each("len(xs)::VARCHAR")), ("(map (λ (_p0) (length [])) x)", "list[int]", each("'0'")),
    ]
    union = " UNION ALL ".join(f"SELECT '{p}' AS program, '{k}' AS type, {v} AS value FROM o" for p, k, v in programs)
    return f"""WITH o AS (SELECT list_sort(list(l_quantity::BIGINT)) AS xs FROM lineitem GROUP BY l_orderkey), v AS ({union})
    SELECT program, type, count(value) AS n, sum(length(value))::BIGINT AS chars, min(value) AS least, max(value) AS most FROM v GROUP BY ALL"""


NAMES = sorted(get_grammar("small").signatures)
RENAMED = "(λ (x) (take {} (map (λ (y) (+ y {})) (reverse (filter (λ (z) (> z {})) x)))))"


def renamed(spark: SparkSession, d: str, k: Column | None) -> DataFrame:
    """Each line's program under names of its own."""
    rows = spread(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"))
    constants = [F.col(c).cast("long").cast("string") for c in ("l_linenumber", "l_quantity", "l_suppkey")]
    parts = RENAMED.split("{}")
    program = F.concat(F.lit(parts[0]), *[x for c, p in zip(constants, parts[1:], strict=True) for x in (c, F.lit(p))])
    row = F.concat_ws("-", "l_orderkey", "l_linenumber")
    out = C.renamed(rows, row, program, NAMES, k)
    return out.select("l_orderkey", "l_linenumber", "program", F.array_join("preamble", ";").alias("preamble"), "bijection")


def _renamed_sql(k: str | None) -> str:
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    pieces = RENAMED.split("{}")
    text = f"'{pieces[0]}'" + "".join(f" || {c}::BIGINT::VARCHAR || '{p}'" for c, p in zip(("l_linenumber", "l_quantity", "l_suppkey"), pieces[1:], strict=True))
    chosen = names if k is None else f"list_filter({names}, lambda n: list_contains(list_transform(list_sort(list_transform({names}, lambda m: md5('pick:' || row || ':' || m) || m))[1:{k}], lambda m: m[33:]), n))"
    return rf"""WITH r AS (SELECT *, l_orderkey || '-' || l_linenumber AS row, {text} AS program FROM lineitem),
    c AS (SELECT *, {chosen} AS own FROM r),
    m AS (SELECT *, list_transform(list_sort(list_transform(own, lambda n: md5('to:' || row || ':' || n) || n)), lambda n: n[33:]) AS new,
      regexp_extract_all(program, '(λ|[()\[\]]|\d+|[^\s()\[\]λ]+)') AS toks FROM c)
    SELECT l_orderkey, l_linenumber, array_to_string(list_transform(toks, lambda t: coalesce(new[list_position(own, t)], t)), ' ') AS program,
      array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct(toks), lambda t: list_contains(own, t)), lambda t: [new[list_position(own, t)], t])), lambda p: p[1] || '=' || p[2]), ';') AS preamble,
      true AS bijection FROM m"""


def method_rows(events: DataFrame) -> DataFrame:
    """Events as a method's answers: several for each user and trial."""
    answer = F.concat(F.lit("["), (F.col("value") / 50).cast("long").cast("string"), F.lit("]"))
    return events.select(
        F.col("user_id").cast("string").alias("id"), F.lit(1).alias("order"), (F.col("event_id") % 11 + 1).cast("int").alias("trial"), F.col("event_id").alias("place"), parsing.response(answer).alias("response"),
        F.col("event_type").alias("program"), (F.col("value") > 40).cast("double").alias("score"), F.col("event_type").alias("run"), F.col("value").alias("cpu"),
    )


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """A method made by name, asked for all trials; every user's twelfth has no rows."""
    rows = method_rows(spark.read.parquet(f"{d}/events.parquet"))
    trials = rows.select("id").distinct().select("id", F.lit(1).alias("order"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("trial"))
    got = files.METHODS.make("table", rows=rows, name="events", efforts=("cpu",)).predict(trials)
    return got.select("id", "trial", F.array_join("response.value", ",").alias("response"), "program", "correct", F.round("mean_correct", 6).alias("mean_correct"), F.round("cpu", 6).alias("cpu"))


PREDICTED_SQL = """WITH r AS (SELECT user_id::VARCHAR AS id, (event_id % 11 + 1)::INT AS trial, event_id, trunc(value / 50)::BIGINT::VARCHAR AS response, event_type AS program, (value > 40)::INT AS score, value AS cpu FROM events),
m AS (SELECT id, trial, avg(score) AS mean_correct, avg(cpu) AS cpu FROM r GROUP BY ALL),
a AS (SELECT id, trial, response FROM r GROUP BY id, trial, response QUALIFY row_number() OVER (PARTITION BY id, trial ORDER BY count(*) DESC, min(event_id)) = 1),
p AS (SELECT id, trial, program FROM r GROUP BY id, trial, program QUALIFY row_number() OVER (PARTITION BY id, trial ORDER BY count(*) DESC, min(event_id)) = 1),
t AS (SELECT DISTINCT id, unnest(range(1, 13))::INT AS trial FROM r)
SELECT id, trial, response, program, coalesce(mean_correct >= 0.5, false) AS correct, round(mean_correct, 6) AS mean_correct, round(cpu, 6) AS cpu FROM t LEFT JOIN m USING (id, trial) LEFT JOIN a USING (id, trial) LEFT JOIN p USING (id, trial)"""


def logged(spark: SparkSession, d: str) -> DataFrame:
    """Events written as the log of a run for each type, and one run of it read by name."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("key"), "value")
    events.write.partitionBy("run").json(path)
    methods.RunLog.register(spark)
    log = spark.read.format("run_log").load(path).where("run = 'click' and value > 20")
    return log.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last"), F.round(F.sum("value"), 4).alias("total"))


LOGGED_SQL = "SELECT event_type AS run, user_id::VARCHAR AS key, count(*) AS n, max(event_id) AS last, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' AND value > 20 GROUP BY ALL"

#: A program for each part, by its number; {} is its size.
BASES = ["(λ (x) (take {} (reverse x)))", "(λ (x) (map (λ (y) (+ y {})) (filter (λ (z) (> z 2)) x)))", "(λ (x) (cons (sum x) (drop {} x)))", "(λ (x) (append x (- (length x) (* {} (max x)))))"]
BASE_SQL = "CASE " + " ".join(f"WHEN p_partkey % {len(BASES)} = {i} THEN '" + t.replace("{}", "' || p_size || '") + "'" for i, t in enumerate(BASES)) + " END"


def varied(spark: SparkSession, d: str) -> DataFrame:
    """Every variant of every part's program."""
    programs = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(BASE_SQL).alias("program"))
    return variants.variants(programs, "p_partkey").select("p_partkey", "template", "variant")


def _varied_sql() -> str:
    table = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in t) + ")" for t in variants.TEMPLATES)
    draw = lambda n: f"({n}_least + ('0x' || left(md5('0:{n}:' || template || ':' || p_partkey), 8))::BIGINT % ({n}_most - {n}_least + 1))::VARCHAR"
    return rf"""WITH t(template, primitive, text, a_least, a_most, b_least, b_most) AS (VALUES {table}),
    p AS (SELECT p_partkey, regexp_extract_all({BASE_SQL}, '(λ|[()\[\]]|\d+|[^\s()\[\]λ]+)') AS toks FROM part)
    SELECT p_partkey, template, array_to_string(list_transform(toks, lambda w: CASE WHEN w = primitive THEN replace(replace(text, '{{a}}', {draw("a")}), '{{b}}', {draw("b")}) ELSE w END), ' ') AS variant
    FROM p JOIN t ON list_contains(toks, primitive)"""


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "contextual_fingerprint": (contextual, _contextual_sql()),
    "enumerated_on_orders": (enumerated, _enumerated_sql()),
    "plugged_method": (predicted, PREDICTED_SQL),
    "run_log_source": (logged, LOGGED_SQL),
    "template_variants": (varied, _varied_sql()),
    "symbols_permuted": (lambda s, d: renamed(s, d, None), _renamed_sql(None)),
    "symbols_partly_permuted": (lambda s, d: renamed(s, d, F.col("l_linenumber").cast("int")), _renamed_sql("l_linenumber")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items()}
