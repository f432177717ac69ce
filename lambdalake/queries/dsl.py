"""One query for each primitive: a program compiled to a column over every order's quantities.

Parameters of a program: ``xs``, an order's sorted quantities; ``k`` in -3..3 and ``j`` in 0..2 by the order's key.
Results are written as text, so that nested lists compare. The SQL says the same in DuckDB's list functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import types as T
from ..dsl.compiler import column, compile_function

PARAMETERS = [T.ListOf(T.INT), T.INT, T.INT]
LISTS_SQL = """SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT))) AS xs, CAST(l_orderkey % 7 - 3 AS BIGINT) AS k,
CAST(l_orderkey % 3 AS BIGINT) AS j FROM lineitem GROUP BY l_orderkey"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("bigint"))).alias("xs"))
    return grouped.select("l_orderkey", "xs", (F.col("l_orderkey") % 7 - 3).alias("k"), (F.col("l_orderkey") % 3).alias("j"))


def text(c: Column, t: T.Type) -> Column:
    """A value as text; NULL stays NULL."""
    if isinstance(t, T.ListOf):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: text(e, t.item)), ","), F.lit("]"))
    return c.cast("string")


def sql_text(e: str, t: T.Type) -> str:
    if isinstance(t, T.ListOf):
        # The list is named once in a one-element list, so that it is not repeated in the text.
        inner = sql_text("e", t.item)
        return f"list_transform([{e}], lambda r: CASE WHEN r IS NULL THEN NULL WHEN len(r) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(r, lambda e: {inner}), ',') || ']' END)[1]"
    return f"CAST({e} AS VARCHAR)"


def low(i: str, n: str) -> str:
    return f"least(greatest(CASE WHEN ({i}) < 0 THEN ({i}) + {n} ELSE ({i}) END, 0), {n})"


def sl(xs: str, i: str, j: str) -> str:
    n = f"len({xs})"
    return f"(CASE WHEN {low(j, n)} <= {low(i, n)} THEN CAST([] AS BIGINT[]) ELSE list_slice({xs}, {low(i, n)} + 1, {low(j, n)}) END)"


def each(e: str) -> str:
    return f"list_transform(xs, lambda x: {e})"


def tests(e: str) -> str:
    return f"list_filter(xs, lambda x: {e})"


#: Program and SQL expression for each primitive.
CASES: dict[str, tuple[str, str]] = {
    "add": ("(map (λ (x) (+ x k)) xs)", each("x + k")),
    "sub": ("(map (λ (x) (- k x)) xs)", each("k - x")),
    "mul": ("(map (λ (x) (* x k)) xs)", each("x * k")),
    "floor_div": ("(map (λ (x) (/ (- x 20) k)) xs)", f"CASE WHEN k = 0 THEN NULL ELSE {each('CAST(floor((x - 20) / CAST(k AS DOUBLE)) AS BIGINT)')} END"),
    "mod": ("(map (λ (x) (% (- x 20) k)) xs)", f"CASE WHEN k = 0 THEN NULL ELSE {each('(((x - 20) % k) + k) % k')} END"),
    "lt": ("(map (λ (x) (< x (* 10 k))) xs)", each("x < 10 * k")),
    "gt": ("(map (λ (x) (> x (* 10 k))) xs)", each("x > 10 * k")),
    "eq": ("(== (reverse xs) xs)", "list_reverse(xs) = xs"),
    "and": ("(filter (λ (x) (and (> x 10) (< x 30))) xs)", tests("x > 10 AND x < 30")),
    "or": ("(filter (λ (x) (or (< x 10) (> x 30))) xs)", tests("x < 10 OR x > 30")),
    "not": ("(filter (λ (x) (not (> x 25))) xs)", tests("NOT x > 25")),
    "is_even": ("(map (λ (x) (is_even (- x 20))) xs)", each("(x - 20) % 2 = 0")),
    "is_odd": ("(map (λ (x) (is_odd (- x 20))) xs)", each("(x - 20) % 2 <> 0")),
    "singleton": ("(singleton (sum xs))", "[CAST(list_sum(xs) AS BIGINT)]"),
    "repeat": ("(repeat (first xs) k)", "list_transform(range(greatest(k, 0)), lambda i: xs[1])"),
    "range": (
        "(range k (first xs) (- j 1))",
        "CASE WHEN j = 1 THEN NULL WHEN j = 2 THEN range(k, xs[1] + 1) WHEN k >= xs[1] + 2 THEN range(k, xs[1] + 1, -1) ELSE CAST([] AS BIGINT[]) END",
    ),
    "cons": ("(cons k xs)", "list_prepend(k, xs)"),
    "append": ("(append xs k)", "list_append(xs, k)"),
    "concat": ("(concat xs (reverse xs))", "list_concat(xs, list_reverse(xs))"),
    "zip": ("(zip xs (drop j xs))", f"list_transform(range(1, len({sl('xs', 'j', 'len(xs)')}) + 1), lambda i: [xs[i], xs[i + j]])"),
    "first": ("(first xs)", "xs[1]"),
    "second": ("(second xs)", "xs[2]"),
    "third": ("(third xs)", "xs[3]"),
    "last": ("(last xs)", "xs[len(xs)]"),
    "nth": ("(nth k xs)", "CASE WHEN k >= 0 THEN xs[k + 1] END"),
    "insert": ("(insert 99 k xs)", f"list_concat(list_append({sl('xs', '0', 'k')}, 99), {sl('xs', 'k', 'len(xs)')})"),
    "replace": ("(replace k 99 xs)", "CASE WHEN k >= 0 AND k < len(xs) THEN list_transform(xs, lambda x, i: CASE WHEN i = k + 1 THEN 99 ELSE x END) END"),
    "swap": ("(swap 0 k xs)", "CASE WHEN k >= 0 AND k < len(xs) THEN list_transform(xs, lambda x, i: CASE WHEN i = 1 THEN xs[k + 1] WHEN i = k + 1 THEN xs[1] ELSE x END) END"),
    "cut_idx": ("(cut_idx k xs)", "CASE WHEN k >= 0 AND k < len(xs) THEN list_filter(xs, lambda x, i: i <> k + 1) END"),
    "cut_val": ("(cut_val (last xs) xs)", "list_filter(xs, lambda x, i: i <> list_position(xs, xs[len(xs)]))"),
    "cut_vals": ("(cut_vals (last xs) xs)", tests("x <> xs[len(xs)]")),
    "drop": ("(drop k xs)", sl("xs", "k", "len(xs)")),
    "droplast": ("(droplast k xs)", f"CASE WHEN k = 0 THEN xs ELSE {sl('xs', '0', '-k')} END"),
    "take": ("(take k xs)", sl("xs", "0", "k")),
    "takelast": ("(takelast k xs)", f"CASE WHEN k > 0 THEN {sl('xs', '-k', 'len(xs)')} ELSE CAST([] AS BIGINT[]) END"),
    "slice": ("(slice k 4 xs)", sl("xs", "k", "4")),
    "cut_slice": ("(cut_slice k 2 xs)", f"list_concat({sl('xs', '0', 'k')}, {sl('xs', '2', 'len(xs)')})"),
    "splice": ("(splice [7 8] k xs)", f"list_concat(list_concat({sl('xs', '0', 'k')}, [7, 8]), {sl('xs', 'k', 'len(xs)')})"),
    "is_in": ("(is_in xs (+ 20 k))", "list_contains(xs, 20 + k)"),
    "length": ("(length xs)", "len(xs)"),
    "max": ("(max xs)", "list_max(xs)"),
    "min": ("(min (drop 2 xs))", "list_min(xs[3:])"),
    "product": ("(product (take 4 xs))", "CAST(list_product(xs[1:4]) AS BIGINT)"),
    "sum": ("(sum xs)", "CAST(list_sum(xs) AS BIGINT)"),
    "reverse": ("(reverse xs)", "list_reverse(xs)"),
    "flatten": ("(flatten (map (λ (x) (repeat x j)) xs))", "flatten(list_transform(xs, lambda x: list_transform(range(j), lambda i: x)))"),
    "map": ("(map (λ (x) (/ 100 (- x 7))) xs)", "CASE WHEN list_contains(xs, 7) THEN NULL ELSE " + each("CAST(floor(100 / CAST(x - 7 AS DOUBLE)) AS BIGINT)") + " END"),
    "mapi": ("(mapi (λ (x i) (* x i)) xs)", "list_transform(xs, lambda x, i: x * (i - 1))"),
    "filter": ("(filter (λ (x) (> x (* 10 j))) xs)", tests("x > 10 * j")),
    "filteri": ("(filteri (λ (i x) (> x (* 5 i))) xs)", "list_filter(xs, lambda x, i: x > 5 * (i - 1))"),
    "fold": ("(fold (λ (acc x) (% (+ (* acc 7) x) 1009)) 1 xs)", "list_reduce(list_prepend(CAST(1 AS BIGINT), xs), lambda acc, x: (acc * 7 + x) % 1009)"),
    "foldi": ("(foldi (λ (acc x i) (+ acc (* x i))) 0 xs)", "CAST(list_sum(list_transform(xs, lambda x, i: x * (i - 1))) AS BIGINT)"),
    "count": ("(count (λ (x) (> x 25)) xs)", f"len({tests('x > 25')})"),
    "find": ("(find is_even xs)", "list_filter(list_transform(xs, lambda x, i: CASE WHEN x % 2 = 0 THEN i - 1 ELSE -1 END), lambda v: v >= 0)"),
    "unique": ("(sort (λ (x) x) (unique xs))", "list_sort(list_distinct(xs))"),
    "sort": ("(sort (λ (x) (- 0 x)) xs)", "list_reverse_sort(xs)"),
    "group": (
        "(group (λ (x) (/ x 10)) xs)",
        "list_transform(list_sort(list_distinct(list_transform(xs, lambda x: x // 10))), lambda g: list_filter(xs, lambda x: x // 10 = g))",
    ),
    "if": ("(if (> (length xs) 3) (take 3 xs) (map (λ (x) (+ x 1)) xs))", f"CASE WHEN len(xs) > 3 THEN xs[1:3] ELSE {each('x + 1')} END"),
    "partial_application": ("(map (+ k) xs)", each("x + k")),
    "nested": ("(map (λ (x) (sum (map (λ (y) (* x y)) (take 2 xs)))) xs)", each("CAST(x * list_sum(xs[1:2]) AS BIGINT)")),
}


def program(name: str) -> str:
    return f"(λ (xs k j) {CASES[name][0]})"


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = result_type(name)
        return lists(spark, sf_dir).select("l_orderkey", text(column(program(name), "xs", "k", "j", types=PARAMETERS), t).alias("out"))

    return run


def result_type(name: str) -> T.Type:
    t = compile_function(program(name), PARAMETERS)[1]
    for _ in PARAMETERS:
        t = t.result
    return t


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"dsl_{name}": query(name) for name in CASES}


def oracle_sql() -> dict[str, str]:
    return {f"dsl_{name}": f"WITH q AS ({LISTS_SQL}) SELECT l_orderkey, {sql_text(sql, result_type(name))} AS out FROM q" for name, (_, sql) in CASES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = column("(λ (xs) (map (λ (x) (* x 2)) (filter (λ (x) (> x 10)) xs)))", "xs", types=PARAMETERS[:1])
    return lists(spark, sf_dir).select("l_orderkey", doubled.alias("doubled"))
