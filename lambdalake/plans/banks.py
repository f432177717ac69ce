"""Bottom-up enumeration with the names in scope: bodies of functions are enumerated like programs, in a bank of their own.

A bank belongs to a context, the names that enclosing functions bind. Its rows are (type, size, program, holes, vectors); ``vectors``
are the values at all points of the context - each test input with each combination of probe values of the names - for each
of the ten places in the round of hole constants at which its first hole may stand. That is the contextual fingerprint: the
first program of each one stays, and none that fails everywhere.

An application's vectors come from its arguments' by one native expression. A functional argument of size s is a body of size
s - 1 from the bank of the context with its parameters; bodies are compiled into the expression, as their values at the probes
do not tell what they do elsewhere. They are part of the plan, so this is for small sizes. Functions stand within one another
``nesting`` + 1 deep at most.

Each level is written to the store and followed by a commit record. A run over the same store goes on after the last level that
has one; what a killed run has left of a level is overwritten.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import types as T
from ..dsl.compiler import column, spark_type
from ..functions.order import numbered
from ..operators.corpus import HOLE_PROBES, PROBES, TEST_SUITE, good
from .enumeration import applications, compositions

#: Bodies that one expression takes.
BODIES_AT_ONCE = 32


@dataclass(frozen=True)
class Context:
    """Names in scope besides the input ``x``, outermost first, and how many functions bind them."""

    names: tuple[tuple[str, str], ...] = ()
    depth: int = 0

    def inside(self, kinds: list[str]) -> tuple[Context, list[str]]:
        """The context within a function of so many parameters, and their names."""
        new = [(f"_p{len(self.names) + i}", k) for i, k in enumerate(kinds)]
        return Context(self.names + tuple(new), self.depth + 1), [n for n, _ in new]

    @property
    def key(self) -> str:
        return "-".join(["top", *(k.replace("[", "_").replace("]", "") for _, k in self.names), str(self.depth)])

    def points(self) -> list[tuple]:
        """(x, value of each name) of all points: inputs, then combinations of probes."""
        return [(x, *values) for x in TEST_SUITE for values in itertools.product(*(PROBES.get(k, [0]) for _, k in self.names))]


def _values(values: list, t: T.Type) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{spark_type(t).simpleString()}>")


def contextual_fingerprint(term: str, context: Context, given: dict[str, Column] | None = None) -> Column:
    """Values, as text, of an open term over ``x``, the context's names and the columns ``given``, at all points of the context."""
    given, points = given or {}, context.points()
    names = [n for n, _ in context.names]
    kinds = [T.ListOf(T.INT), *(T.read(k) for _, k in context.names), *[T.INT] * len(given)]
    program = f"(λ ({' '.join(['x', *names, *given])}) {term})"
    table = [_values([p[i] for p in points], kinds[i]) for i in range(1 + len(names))]
    return F.transform(F.sequence(F.lit(0), F.lit(len(points) - 1)), lambda k: value_text(column(program, *[F.get(t, k) for t in table], *given.values(), types=kinds)))


def value_text(value: Column) -> Column:
    """JSON text of a value; NULL for a failure."""
    one = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


class Enumerator:
    """Banks of programs over one integer list, in a store of their own."""

    def __init__(self, spark: SparkSession, store: str, grammar: str = "small", only: list[str] | None = None, nesting: int = 2):
        self.spark, self.store, self.nesting = spark, store.rstrip("/"), nesting
        #: Committed levels, and bodies, that this run has seen.
        self.seen: dict[tuple[str, int], dict[str, int]] = {}
        self.made: dict[tuple[str, int, str], list[tuple[str, int]]] = {}
        self.calls = [c for c in applications(grammar) if (only is None or c[0] in only) and T.show(c[2]) in T.UNIVERSE]
        self.about = hashlib.sha256(repr((grammar, only, nesting, TEST_SUITE, PROBES, HOLE_PROBES)).encode()).hexdigest()

    # Levels on disk.

    def path(self, context: Context, size: int, kind: str) -> str:
        return f"{self.store}/{context.key}/size-{size}/{kind.replace('[', '_').replace(']', '')}"

    def record(self, context: Context, size: int) -> dict[str, int] | None:
        """The types of a committed level and how many rows each has."""
        if (context.key, size) in self.seen:
            return self.seen[context.key, size]
        try:
            row = self.spark.read.schema("about string, counts map<string,long>").json(f"{self.store}/{context.key}/commit-{size}").first()
        except AnalysisException:
            return None
        if row is None:
            return None
        if row.about != self.about:
            raise ValueError("the store belongs to an enumeration with other settings")
        self.seen[context.key, size] = row.counts or {}
        return self.seen[context.key, size]

    def commit(self, context: Context, size: int, counts: dict[str, int]) -> None:
        rows = self.spark.createDataFrame([(self.about, counts)], "about string, counts map<string,long>")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.store}/{context.key}/commit-{size}")

    def level(self, context: Context, size: int, kind: str) -> DataFrame | None:
        """The rows of a type and size, worked out if need be; None if there are none."""
        counts = self.record(context, size)
        if counts is None:
            counts = self.build(context, size)
        return self.spark.read.parquet(self.path(context, size, kind)) if counts.get(kind) else None

    def build(self, context: Context, size: int) -> dict[str, int]:
        for s in range(1, size):  # smaller ones first
            self.level(context, s, "int")
        rows = self.atoms(context) if size == 1 else self.applied(context, size)
        counts: dict[str, int] = {}
        for kind, fresh in rows.items():
            path = self.path(context, size, kind)
            fresh.write.mode("overwrite").parquet(path)
            counts[kind] = self.spark.read.parquet(path).count()
        self.commit(context, size, counts)
        self.seen[context.key, size] = counts
        return counts

    # What a level has.

    def atoms(self, context: Context) -> dict[str, DataFrame]:
        """The input, the names, a hole, the two truths, empty lists; of equal vectors the first."""
        points, rounds = context.points(), len(HOLE_PROBES)
        n = len(points)
        rows: dict[str, list[tuple[str, int, list]]] = {k: [] for k in T.UNIVERSE}
        rows["int"].append(("int_hole", 1, [[HOLE_PROBES[o]] * n for o in range(rounds)]))
        rows["bool"] += [(w, 0, [[w == "true"] * n] * rounds) for w in ("true", "false")]
        for k in T.UNIVERSE:
            if k.startswith("list"):
                rows[k].append(("[]", 0, [[[]] * n] * rounds))
        for i, (name, kind) in enumerate((("x", "list[int]"), *context.names)):
            if kind in rows:
                rows[kind].append((name, 0, [[p[i] for p in points]] * rounds))
        out = {}
        for kind, found in rows.items():
            first = {json.dumps(v): (i, p, h, v) for i, (p, h, v) in reversed(list(enumerate(found)))}
            item = spark_type(T.read(kind)).simpleString()
            table = self.spark.createDataFrame(sorted(first.values(), key=lambda r: r[0]), f"ord long, program string, holes int, vectors array<array<{item}>>")
            out[kind] = table.select("program", "holes", F.lit(1).alias("size"), "ord", "vectors")
        return out

    def bodies(self, context: Context, t: T.Type, size: int) -> list[tuple[str, int]]:
        """Functions of a type and size, as (text, holes)."""
        kinds = []
        while isinstance(t, T.Fn):
            kinds.append(T.show(t.argument))
            t = t.result
        child, names = context.inside(kinds)
        key = (child.key, size, T.show(t))
        if key not in self.made:
            rows = self.level(child, size - 1, T.show(t)) if size > 1 else None
            # Part of the plan to come: as many as the enumeration has bodies of this size.
            self.made[key] = [] if rows is None else [(f"(λ ({' '.join(names)}) {r.program})", r.holes) for r in rows.select("program", "holes", "ord").orderBy("ord").collect()]
        return self.made[key]

    def vectors(self, context: Context, name: str, arguments: list[T.Type], functions: dict[int, tuple[str, int]]) -> Column:
        """Of an application, from columns v0, v1, ... and their holes h0, h1, ...: argument i stands as many places on in the round
        of constants as there are holes to its left."""
        live = [i for i in range(len(arguments)) if i not in functions]
        points, rounds = context.points(), len(HOLE_PROBES)
        inner = [("x", T.ListOf(T.INT)), *((n, T.read(k)) for n, k in context.names)]
        table = [_values([p[i] for p in points], t) for i, (_, t) in enumerate(inner)]
        constants, parts, holes = F.array(*map(F.lit, HOLE_PROBES)), [], []
        for i in range(len(arguments)):
            if i in functions:
                text, n = functions[i]
                for j in range(n):
                    text = text.replace("int_hole", f"_h{i}_{j}", 1)
                    holes.append((i, j))
                parts.append(text)
            else:
                parts.append(f"_a{i}")
        program = f"(λ ({' '.join([*(f'_a{i}' for i in live), *(n for n, _ in inner), *(f'_h{i}_{j}' for i, j in holes)])}) ({name} {' '.join(parts)}))"
        types = [*(arguments[i] for i in live), *(t for _, t in inner), *[T.INT] * len(holes)]

        def at(o: Column, k: Column) -> Column:
            values, ends, shift = [], [], F.lit(0)
            for i in range(len(arguments)):
                if i in functions:
                    ends += [F.get(constants, F.pmod(o + shift + j, F.lit(rounds))).cast("long") for j in range(functions[i][1])]
                    shift = shift + functions[i][1]
                else:
                    values.append(F.get(F.get(F.col(f"v{i}"), F.pmod(o + shift, F.lit(rounds))), k))
                    shift = shift + F.col(f"h{i}")
            return column(program, *values, *[F.get(t, k) for t in table], *ends, types=types)

        return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda o: F.transform(F.sequence(F.lit(0), F.lit(len(points) - 1)), lambda k: at(o, k)))

    def combined(self, context: Context, arguments: list[T.Type], sizes: dict[int, int]) -> DataFrame | None:
        """All combinations of bank rows of the given sizes, as columns v0, h0, t0, o0, v1, ..."""
        rows, places = None, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for i, s in sizes.items():
            own = self.level(context, s, T.show(arguments[i]))
            if own is None:
                return None
            own = own.select(F.col("vectors").alias(f"v{i}"), F.col("holes").alias(f"h{i}"), F.col("program").alias(f"t{i}"), F.col("ord").alias(f"o{i}"))
            if rows is None:
                rows, first = own, f"o{i}"
            else:  # all combinations are wanted: the rows so far are dealt over places, and each place gets all of the next ones
                dealt = rows.withColumn("deal", F.pmod(F.xxhash64(first, F.lit(i)), F.lit(places)))
                rows = dealt.join(own.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long")))), "deal").drop("deal")
        return rows

    def applied(self, context: Context, size: int) -> dict[str, DataFrame]:
        """The first program of each new behaviour of this size, by type. The order is: primitive, its types, the sizes and then the
        places of its arguments."""
        found: dict[str, list[DataFrame]] = {}
        for rank, (name, arguments, result) in enumerate(self.calls):
            wanted = [i for i, a in enumerate(arguments) if isinstance(a, T.Fn)]
            if wanted and context.depth > self.nesting or len(wanted) == len(arguments):
                continue
            for c, sizes in enumerate(compositions(size - 1, len(arguments))):
                choices = [list(enumerate(self.bodies(context, arguments[i], sizes[i]))) for i in wanted]
                if not all(choices):
                    continue
                rows = self.combined(context, arguments, {i: s for i, s in enumerate(sizes) if i not in wanted})
                if rows is None:
                    continue
                picks = list(itertools.product(*choices))
                for lo in range(0, len(picks), BODIES_AT_ONCE):
                    made = []
                    for pick in picks[lo : lo + BODIES_AT_ONCE]:
                        functions = {i: f for i, (_, f) in zip(wanted, pick, strict=True)}
                        text = F.concat(F.lit(f"({name}"), *[x for i in range(len(arguments)) for x in (F.lit(" "), F.lit(functions[i][0]) if i in functions else F.col(f"t{i}"))], F.lit(")"))
                        order = {i: F.lit(k).cast("long") for i, (k, _) in zip(wanted, pick, strict=True)}
                        place = F.array(F.lit(rank).cast("long"), F.lit(c).cast("long"), *[order[i] if i in order else F.col(f"o{i}") for i in range(len(arguments))])
                        holes = sum((F.col(f"h{i}") for i in range(len(arguments)) if i not in functions), F.lit(sum(n for _, n in functions.values())))
                        made.append(F.struct(text.alias("program"), holes.cast("int").alias("holes"), self.vectors(context, name, arguments, functions).alias("vectors"), place.alias("place")))
                    found.setdefault(T.show(result), []).append(rows.select(F.explode(F.array(*made)).alias("made")).select("made.*"))
        out = {}
        for kind, parts in found.items():
            level = parts[0]
            for p in parts[1:]:
                level = level.unionByName(p)
            alive = F.exists("vectors", lambda o: F.exists(o, lambda v: v.isNotNull()))
            first = level.where(alive).groupBy("vectors").agg(F.min(F.struct("place", "program", "holes")).alias("f")).select("vectors", "f.*")
            for s in range(1, size):
                known = self.level(context, s, kind)
                first = first if known is None else first.join(known.select("vectors"), "vectors", "left_anti")
            out[kind] = numbered(first, "ord", "place").select("program", "holes", F.lit(size).alias("size"), "ord", "vectors")
        return out

    # What comes out.

    def bank(self, most_size: int, context: Context = Context()) -> DataFrame:
        """(program, type, size, holes, fp) of all sizes; fp has the values with the first hole at the first constant, as text."""
        out = None
        for size in range(1, most_size + 1):
            for kind in T.UNIVERSE:
                rows = self.level(context, size, kind)
                if rows is not None:
                    fp = F.transform(F.get("vectors", F.lit(0)), value_text)
                    own = rows.select("program", F.lit(kind).alias("type"), "size", "holes", fp.alias("fp"))
                    out = own if out is None else out.unionByName(own)
        return out

    def corpus(self, most_size: int, **limits: float) -> DataFrame:
        """The bank's programs that pass the quality filter, closed over ``x``."""
        kept = self.bank(most_size).where(good(F.col("fp"), **limits))
        return kept.withColumn("program", F.concat(F.lit("(λ (x) "), "program", F.lit(")")))
