"""The 57 primitives as Spark columns.

Every builder gets columns (or, for functional arguments, Python functions of columns) that are cheap to
mention more than once, and returns one column. Failure is NULL. Lists never hold NULL: what builds a
list from values guards them. Integers are 64-bit; an overflow is a failure. Nothing here uses Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dsl.primitives import MAX_LIST

C = Column
LONG = "bigint"


def lit(x: int) -> C:
    return F.lit(x).cast(LONG)


def size(xs: C) -> C:
    return F.size(xs).cast(LONG)


def only(condition: C, value: C) -> C:
    """The value where the condition holds, else failure."""
    return F.when(condition, value)


def all_known(*args: C) -> C:
    known = args[0].isNotNull()
    for a in args[1:]:
        known = known & a.isNotNull()
    return known


def let(value: C, body: Callable[[C], C]) -> C:
    """Name an intermediate, so that it is worked out once however often it is mentioned."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def capped(xs: C) -> C:
    return let(xs, lambda v: only(F.size(v) <= MAX_LIST, v))


def low(i: C, n: C) -> C:
    """A slice bound: negative ones count from the end, all are clamped to 0..n."""
    return only(all_known(i, n), F.least(F.greatest(F.when(i < 0, i + n).otherwise(i), lit(0)), n))


def part(xs: C, i: C, j: C) -> C:
    """xs[i:j] with negative and far bounds."""
    n = size(xs)
    long = low(j, n) - low(i, n)
    return F.slice(xs, (low(i, n) + 1).cast("int"), F.when(long > 0, long).when(long <= 0, lit(0)).cast("int"))


def whole(values: C) -> C:
    """A list of results, or failure if one of them failed."""
    return let(values, lambda v: only(~F.exists(v, lambda e: e.isNull()), v))


def floor_div(a: C, b: C) -> C:
    quotient = F.call_function("div", a, b)
    usable = (b != 0) & ~((b == -1) & (a == lit(-(1 << 63))))
    return only(usable, quotient - F.when((F.try_mod(a, b) != 0) & ((a < 0) != (b < 0)), 1).otherwise(0))


def modulo(a: C, b: C) -> C:
    r = F.try_mod(a, b)
    return only(b != 0, F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))


def repeat(x: C, n: C) -> C:
    return only(all_known(x, n) & (n <= MAX_LIST), F.array_repeat(x, F.greatest(n, lit(0)).cast("int")))


def span(a: C, b: C, step: C) -> C:
    """From a by step: up to and with b; a negative step stops before b + 1."""
    up = only((F.call_function("div", b - a, step) < MAX_LIST), F.sequence(a, b, step))
    down = only((F.call_function("div", b + 2 - a, step) < MAX_LIST), F.sequence(a, b + 2, step))
    empty = F.array().cast("array<bigint>")
    found = F.when((step > 0) & (a <= b), up).when((step < 0) & (a >= b + 2), down).otherwise(empty)
    return only(all_known(a, b, step) & (step != 0), found)


def insert(x: C, i: C, xs: C) -> C:
    return only(all_known(x, i, xs), capped(F.concat(part(xs, lit(0), i), F.array(x), part(xs, i, size(xs)))))


def inside(i: C, xs: C) -> C:
    return (i >= 0) & (i < size(xs))


def at(xs: C, i: C) -> C:
    return F.get(xs, i.cast("int"))


def replace(i: C, x: C, xs: C) -> C:
    return only(all_known(i, x, xs) & inside(i, xs), F.transform(xs, lambda e, k: F.when(k == i, x).otherwise(e)))


def swap(i: C, j: C, xs: C) -> C:
    moved = lambda e, k: F.when(k == i, at(xs, j)).when(k == j, at(xs, i)).otherwise(e)
    return only(all_known(i, j, xs) & inside(i, xs) & inside(j, xs), F.transform(xs, moved))


def cut_val(x: C, xs: C) -> C:
    place = F.array_position(xs, x)
    return only(all_known(x, xs), let(place, lambda p: F.filter(xs, lambda _, k: k != p - 1)))


def zipped(xs: C, ys: C) -> C:
    n = F.least(F.size(xs), F.size(ys))
    return only(all_known(xs, ys), let(n, lambda m: F.zip_with(F.slice(xs, 1, m), F.slice(ys, 1, m), lambda a, b: F.array(a, b))))


def folded(f: Callable, start: C, xs: C) -> C:
    return only(all_known(start, xs), F.aggregate(xs, start, lambda acc, x: only(acc.isNotNull(), f(acc, x))))


def folded_index(f: Callable, start: C, xs: C) -> C:
    pairs = F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.cast(LONG).alias("i")))
    return only(all_known(start, xs), F.aggregate(pairs, start, lambda acc, p: only(acc.isNotNull(), f(acc, p["x"], p["i"]))))


def picked(xs: C, tests: C) -> C:
    """Elements whose test holds; failure if a test failed."""
    return let(whole(tests), lambda t: only(all_known(t), F.filter(xs, lambda _, k: F.get(t, k))))


def counted(xs: C, f: Callable) -> C:
    return let(whole(F.transform(xs, f)), lambda t: size(F.filter(t, lambda e: e)))


def found(xs: C, f: Callable) -> C:
    places = lambda t: F.filter(F.transform(t, lambda e, i: F.when(e, i.cast(LONG)).otherwise(lit(-1))), lambda v: v >= 0)
    return let(whole(F.transform(xs, f)), places)


def keyed(xs: C, f: Callable) -> C:
    rows = F.transform(xs, lambda x, i: F.struct(f(x).alias("k"), i.alias("i"), x.alias("v")))
    return let(rows, lambda r: only(~F.exists(r, lambda e: e["k"].isNull()), r))


def ordered(f: Callable, xs: C) -> C:
    """Stable: by key, then by place."""
    return F.transform(F.array_sort(keyed(xs, f)), lambda r: r["v"])


def grouped(f: Callable, xs: C) -> C:
    """Groups in the order of their first members."""
    members = lambda rows, k: F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["v"])
    return let(keyed(xs, f), lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda r: r["k"])), lambda k: members(rows, k)))


def alone(x: C) -> C:
    return only(all_known(x), F.array(x))


BUILDERS: dict[str, Callable[..., C]] = {
    "+": F.try_add,
    "-": F.try_subtract,
    "*": F.try_multiply,
    "/": floor_div,
    "%": modulo,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "==": lambda a, b: a == b,
    "and": lambda a, b: only(all_known(a, b), a & b),
    "or": lambda a, b: only(all_known(a, b), a | b),
    "not": lambda a: ~a,
    "is_even": lambda x: x % 2 == 0,
    "is_odd": lambda x: x % 2 != 0,
    "singleton": alone,
    "repeat": repeat,
    "range": span,
    "cons": lambda x, xs: only(all_known(x, xs) & (F.size(xs) < MAX_LIST), F.array_prepend(xs, x)),
    "append": lambda xs, x: only(all_known(x, xs) & (F.size(xs) < MAX_LIST), F.array_append(xs, x)),
    "concat": lambda xs, ys: capped(F.concat(xs, ys)),
    "zip": zipped,
    "first": lambda xs: F.get(xs, F.lit(0)),
    "second": lambda xs: F.get(xs, F.lit(1)),
    "third": lambda xs: F.get(xs, F.lit(2)),
    "last": lambda xs: F.try_element_at(xs, F.lit(-1)),
    "nth": lambda i, xs: only(inside(i, xs), at(xs, i)),
    "insert": insert,
    "replace": replace,
    "swap": swap,
    "cut_idx": lambda i, xs: only(inside(i, xs), F.filter(xs, lambda _, k: k != i)),
    "cut_val": cut_val,
    "cut_vals": lambda x, xs: F.array_remove(xs, x),
    "drop": lambda n, xs: part(xs, n, size(xs)),
    "droplast": lambda n, xs: F.when(n == 0, xs).otherwise(part(xs, lit(0), -n)),
    "take": lambda n, xs: part(xs, lit(0), n),
    "takelast": lambda n, xs: only(all_known(n, xs), F.when(n > 0, part(xs, -n, size(xs))).otherwise(F.slice(xs, 1, 0))),
    "slice": lambda i, j, xs: part(xs, i, j),
    "cut_slice": lambda i, j, xs: F.concat(part(xs, lit(0), i), part(xs, j, size(xs))),
    "splice": lambda ys, i, xs: capped(F.concat(part(xs, lit(0), i), ys, part(xs, i, size(xs)))),
    "is_in": lambda xs, x: F.array_contains(xs, x),
    "length": size,
    "max": lambda xs: F.array_max(xs),
    "min": lambda xs: F.array_min(xs),
    "product": lambda xs: F.aggregate(xs, lit(1), lambda a, x: F.try_multiply(a, x)),
    "sum": lambda xs: F.aggregate(xs, lit(0), lambda a, x: F.try_add(a, x)),
    "reverse": lambda xs: F.reverse(xs),
    "flatten": lambda xss: capped(F.flatten(xss)),
    "map": lambda f, xs: whole(F.transform(xs, lambda x: f(x))),
    "mapi": lambda f, xs: whole(F.transform(xs, lambda x, i: f(x, i.cast(LONG)))),
    "filter": lambda f, xs: picked(xs, F.transform(xs, lambda x: f(x))),
    "filteri": lambda f, xs: picked(xs, F.transform(xs, lambda x, i: f(i.cast(LONG), x))),
    "fold": folded,
    "foldi": folded_index,
    "count": lambda f, xs: counted(xs, lambda x: f(x)),
    "find": lambda f, xs: found(xs, lambda x: f(x)),
    "unique": lambda xs: F.array_distinct(xs),
    "sort": lambda f, xs: ordered(lambda x: f(x), xs),
    "group": lambda f, xs: grouped(lambda x: f(x), xs),
}
