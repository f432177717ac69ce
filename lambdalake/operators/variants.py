"""Programs in which a primitive means something else: templates as a table, parameters drawn by hash, macros put in as columns.

A template has a primitive of which it is a variant, a function in its place with parameters ``{a}`` and ``{b}``, and the ranges that they
are drawn from. Each use of the primitive in a program becomes the function; the draw is that of the row and the template, so
that it is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import spread
from .corpus import tokens

#: (name, primitive, function, least and most a, least and most b)
TEMPLATES = [
    ("add-round", "+", "(λ (u v) (% (+ u v) {a}))", 7, 50, 0, 0),
    ("add-scaled", "+", "(λ (u v) (+ (* {a} u) (* {b} v)))", 1, 4, 1, 4),
    ("subtract-other-way", "-", "(λ (u v) (- v (+ u {a})))", 0, 5, 0, 0),
    ("times-then-more", "*", "(λ (u v) (+ (* u v) {a}))", 1, 9, 0, 0),
    ("greater-by", ">", "(λ (u v) (> u (+ v {a})))", 1, 6, 0, 0),
    ("even-after-shift", "is_even", "(λ (u) (is_even (/ u {a})))", 2, 5, 0, 0),
    ("turned", "reverse", "(λ (us) (concat (drop {a} us) (take {a} us)))", 1, 4, 0, 0),
    ("reverse-the-rest", "reverse", "(λ (us) (concat (take {a} us) (reverse (drop {a} us))))", 1, 3, 0, 0),
    ("take-later", "take", "(λ (n us) (take n (drop {a} us)))", 1, 3, 0, 0),
    ("take-until-full", "take", "(λ (n us) (take (if (> n {a}) {a} n) us))", 2, 6, 0, 0),
    ("drop-in-steps", "drop", "(λ (n us) (drop (* n {a}) us))", 2, 3, 0, 0),
    ("cons-shifted", "cons", "(λ (u us) (cons (+ u {a}) us))", 1, 9, 0, 0),
    ("sum-by-place", "sum", "(λ (us) (foldi (λ (i s u) (+ s (* u (+ i {a})))) 0 us))", 0, 3, 0, 0),
    ("sum-of-some", "sum", "(λ (us) (sum (filter (λ (u) (> u {a})) us)))", 0, 9, 0, 0),
    ("length-above", "length", "(λ (us) (count (λ (u) (> u {a})) us))", 0, 9, 0, 0),
    ("map-then-more", "map", "(λ (f us) (map (λ (u) (+ (f u) {a})) us))", 1, 9, 0, 0),
    ("filter-or-small", "filter", "(λ (p us) (filter (λ (u) (or (p u) (< u {a}))) us))", 1, 6, 0, 0),
    ("largest-at-least", "max", "(λ (us) (max (cons {a} us)))", 1, 9, 0, 0),
    ("append-twice", "append", "(λ (us u) (append (append us u) (+ u {a})))", 0, 4, 0, 0),
]
FIELDS = "template string, primitive string, text string, a_least int, a_most int, b_least int, b_most int"


def templates(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if rows is None else rows, FIELDS)


def _drawn(row: Column, name: str, least: Column, most: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("template"), row)), 1, 8), 16, 10).cast("long")
    return (least + h % (most - least + 1)).cast("string")


def variants(programs: DataFrame, row: str, table: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(``row``, template, primitive, macro, variant) of programs (``row``, program): one row for each program and each template of a
    primitive that it uses. The templates are sent to the programs, which are dealt out over tasks, and never the other way round: by
    the size of its file a table of programs looks small, before its texts and primitives are made from it."""
    table = templates(programs.sparkSession) if table is None else table
    used = spread(programs.select(row, "program")).select(row, "program", tokens(F.col("program")).alias("toks")).withColumn("primitive", F.explode(F.array_distinct("toks")))
    out = used.join(F.broadcast(table), "primitive")
    key = F.col(row).cast("string")
    macro = F.replace(F.replace(F.col("text"), F.lit("{a}"), _drawn(key, "a", F.col("a_least"), F.col("a_most"), seed)), F.lit("{b}"), _drawn(key, "b", F.col("b_least"), F.col("b_most"), seed))
    out = out.withColumn("macro", macro)
    return out.select(row, "template", "primitive", "macro", F.array_join(F.transform("toks", lambda t: F.when(t == F.col("primitive"), F.col("macro")).otherwise(t)), " ").alias("variant"))
