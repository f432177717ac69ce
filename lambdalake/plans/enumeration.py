"""Bottom-up enumeration of programs, a set at a time.

A bank row is (type, size, program, holes, vectors): ``vectors`` holds, for each of the ten places in the
round of probe constants at which its first hole may stand, its values on the test inputs as JSON text. An
application's vector is worked out from its arguments' vectors: first-order primitives are compiled once, as
columns over one struct of values, and applied to all combinations of argument rows of given types and
sizes by joins on (type, size). Each level keeps the first program of each new behaviour and is written to the
shared folder, so lineage stays short and lost executors cost one level at most.

Functional arguments are closed functions from a table of bodies; they are applied as columns as well.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import types as T
from ..dsl.compiler import column, spark_type
from ..dsl.primitives import get_grammar
from ..functions.order import numbered
from ..operators.corpus import HOLE_PROBES, TEST_SUITE

#: Functions that higher-order primitives are given, by type.
BODIES = {
    "int -> int": ["(λ (v) (+ v 1))", "(λ (v) (* v 2))", "(λ (v) (- 0 v))"],
    "int -> bool": ["is_even", "(λ (v) (> v 2))"],
}


def compositions(n: int, parts: int) -> list[tuple[int, ...]]:
    """All ordered ways to write n as a sum of so many positive numbers."""
    if parts == 1:
        return [(n,)] if n >= 1 else []
    return [(k, *rest) for k in range(1, n - parts + 2) for rest in compositions(n - k, parts - 1)]


def _ddl(t: T.Type) -> str:
    return spark_type(t).simpleString()


def _materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name the folder it shares in spark.checkpoint.dir")
    path = f"{(folder or '/tmp/checkpoints').rstrip('/')}/bank-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def atoms(spark: SparkSession, t: T.Type) -> DataFrame:
    """Leaves of a type: the input, a hole, the two truths, empty lists."""
    n, rounds = len(TEST_SUITE), len(HOLE_PROBES)
    array = f"array<array<{_ddl(t)}>>"
    name, rows = T.show(t), []
    if name == "int":
        rows.append((0, "int_hole", 1, [[HOLE_PROBES[o]] * n for o in range(rounds)]))
    elif name == "bool":
        rows += [(i, w, 0, [[w == "true"] * n] * rounds) for i, w in enumerate(("true", "false"))]
    else:
        rows.append((0, "[]", 0, [[[]] * n] * rounds))
    if name == "list[int]":
        rows.append((1, "x", 0, [TEST_SUITE] * rounds))
    return spark.createDataFrame(rows, f"seq int, program string, holes int, vectors {array}").withColumn("size", F.lit(1)).withColumn("ord", F.col("seq").cast("long"))


def _apply(name: str, arguments: list[T.Type], functions: dict[int, str]) -> Column:
    """Vectors of an application from columns a0.v, a1.v, ... and their holes: argument i stands as many
    places on in the round as there are holes to its left."""
    live = [i for i in range(len(arguments)) if i not in functions]
    params = [f"p{i}" for i in live]
    parts = [functions.get(i, f"p{i}") for i in range(len(arguments))]
    program = f"(λ ({' '.join(params)}) ({name} {' '.join(parts)}))"

    def at(offset: Column, k: Column) -> Column:
        values, shift = [], F.lit(0)
        for i in live:
            values.append(F.get(F.get(F.col(f"v{i}"), F.pmod(offset + shift, F.lit(len(HOLE_PROBES)))), k))
            shift = shift + F.col(f"h{i}")
        return column(program, *values, types=[arguments[i] for i in live])

    return F.transform(F.sequence(F.lit(0), F.lit(len(HOLE_PROBES) - 1)), lambda o: F.transform(F.sequence(F.lit(0), F.lit(len(TEST_SUITE) - 1)), lambda k: at(o, k)))


def applications(grammar: str) -> list[tuple[str, list[T.Type], T.Type]]:
    """Every primitive with each choice of ground types, as (name, argument types, result type)."""
    out = []
    for name, signature in get_grammar(grammar).signatures.items():
        for pick in T.instantiations(signature):
            names: dict[str, T.Type] = dict(pick)
            t, arguments = T.read(signature, names), []
            while isinstance(t, T.Fn):
                arguments.append(t.argument)
                t = t.result
            out.append((name, arguments, t))
    return out


def enumerate_programs(spark: SparkSession, most_size: int, grammar: str = "small", only: list[str] | None = None, bodies: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Banks by type, all sizes up to ``most_size``; each row the first program of its behaviour.

    The order is: size, then primitive, its types, the sizes and the places of its arguments."""
    bodies = BODIES if bodies is None else bodies
    bank = {name: atoms(spark, T.read(name)) for name in T.UNIVERSE}
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    calls = [c for c in applications(grammar) if only is None or c[0] in only]
    for size in range(2, most_size + 1):
        found: dict[str, list[DataFrame]] = {}
        for rank, (name, arguments, result) in enumerate(calls):
            kind = T.show(result)
            if kind not in bank:
                continue
            wanted = [i for i, a in enumerate(arguments) if isinstance(a, T.Fn)]
            choices = [bodies.get(T.show(arguments[i]), []) for i in wanted]
            live = [i for i in range(len(arguments)) if i not in wanted]
            for b, pick in enumerate(itertools.product(*choices)):
                functions = dict(zip(wanted, pick, strict=True))
                for c, sizes in enumerate(compositions(size - 1 - len(wanted), len(live))):
                    rows = None
                    for i, s in zip(live, sizes, strict=True):
                        own = bank[T.show(arguments[i])].where(F.col("size") == s).select(F.col("vectors").alias(f"v{i}"), F.col("holes").alias(f"h{i}"), F.col("program").alias(f"t{i}"), F.col("ord").alias(f"o{i}"))
                        # All combinations are wanted: the rows so far are dealt over places, and each place gets all of the next bank.
                        if rows is None:
                            rows, first = own, f"o{i}"
                        else:
                            dealt = rows.withColumn("deal", F.pmod(F.xxhash64(first, F.lit(i)), F.lit(places)))
                            rows = dealt.join(own.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long")))), "deal").drop("deal")
                    text = F.concat(F.lit(f"({name}"), *[x for i in range(len(arguments)) for x in (F.lit(" "), F.lit(functions[i]) if i in functions else F.col(f"t{i}"))], F.lit(")"))
                    found.setdefault(kind, []).append(
                        rows.select(
                            text.alias("program"), sum((F.col(f"h{i}") for i in live), F.lit(0)).alias("holes"), _apply(name, arguments, functions).alias("vectors"),
                            F.array(*[F.lit(x).cast("long") for x in (rank, b, c)], *[F.col(f"o{i}") for i in live]).alias("place"),
                        )
                    )
        for kind, parts in found.items():
            level = parts[0]
            for p in parts[1:]:
                level = level.unionByName(p)
            alive = F.size(F.filter(F.get("vectors", F.lit(0)), lambda v: v.isNotNull())) > 0
            first = level.where(alive).groupBy("vectors").agg(F.min(F.struct("place", "program", "holes")).alias("f")).select("vectors", "f.*")
            fresh = first.join(bank[kind].select("vectors"), "vectors", "left_anti")
            fresh = numbered(fresh, "ord", "place").withColumn("size", F.lit(size)).withColumn("ord", F.col("ord") + (size << 48))
            bank[kind] = _materialize(bank[kind].select("vectors", "program", "holes", "size", "ord").unionByName(fresh.select("vectors", "program", "holes", "size", "ord")))
    return bank


def corpus(bank: dict[str, DataFrame]) -> DataFrame:
    """One table of (program, type, size, holes, fp) from the banks; fp is at the first place of the round, as text."""
    parts = []
    for kind, rows in bank.items():
        is_list = kind.startswith("list")
        text = F.transform(F.get("vectors", F.lit(0)), lambda v: F.to_json(v) if is_list else v.cast("string"))
        parts.append(rows.select(F.concat(F.lit("(λ (x) "), "program", F.lit(")")).alias("program"), F.lit(kind).alias("type"), "size", "holes", text.alias("fp")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
