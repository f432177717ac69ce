"""Readers with the schemas that the operators expect, and writers of results.

Readers never infer schemas: tables are read as text (``functions.parsing`` makes values of cells), corpora
by their fixed fields. Everything goes through Spark's own readers, so paths can be in any store.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing

CORPUS = "program string, type string, size int"
SIMPLIFIED = f"{CORPUS}, original_program string, original_size int, reduction_ratio double"
METRICS = "iteration long, generated_cumulative long, novel_cumulative long, generated struct<depth: array<int>, size: array<int>>, novel struct<depth: array<int>, size: array<int>>"
EFFORT = {
    "mpl": ["time", "count", "lposterior"], "codex": ["cpu", "count"], "fleet": ["cpu", "count"], "enumeration": ["cpu", "count"],
    "robustfill": ["cpu", "count"], "metagol": ["cpu"], "fleet_best": ["cpu", "count", "lposterior", "lprior", "llikelihood"],
}


def program_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines, one program each, with no order."""
    return spark.read.text(path).select(F.trim("value").alias("program")).where("program != ''").distinct()


def corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A JSON array of program records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def corpora(spark: SparkSession, paths: list[str], schema: str = CORPUS) -> DataFrame:
    out = corpus(spark, paths[0], schema)
    for p in paths[1:]:
        out = out.unionByName(corpus(spark, p, schema))
    return out


def write_corpus(programs: DataFrame, path: str, most: int = 100_000) -> None:
    """JSON lines in files of at most ``most`` records."""
    programs.write.option("maxRecordsPerFile", most).json(path)


def manifest(programs: DataFrame) -> DataFrame:
    """Counts by type and size."""
    return programs.groupBy("type", "size").agg(F.count(F.lit(1)).alias("n"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run's metrics."""
    return spark.read.schema(METRICS).json(path)


def table(spark: SparkSession, path: str, where: dict[str, object] | None = None) -> DataFrame:
    """A CSV table as text, with equality filters compared as text; a filter that leaves nothing raises."""
    # With a header, columns are named from the first line; all stay text. Quoted cells may have line feeds in them.
    rows = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name).cast("string") == str(value))
    if where and rows.isEmpty():
        raise ValueError(f"no rows of {path} with {where}")
    return rows


def functions(spark: SparkSession, path: str) -> DataFrame:
    """id, program, gloss, and the columns found to be truths as booleans; other columns stay text."""
    rows = table(spark, path)
    truths = parsing.boolean_columns(rows)
    return rows.withColumns({c: parsing.feature(F.col(c)) for c in truths})


def stimuli(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path)
    return rows.select("id", F.col("order").cast("int").alias("order"), F.col("trial").cast("int").alias("trial"), parsing.int_list(F.col("input")).alias("input"), parsing.int_list(F.col("output")).alias("output"))


def tasks(functions_table: DataFrame, stimuli_table: DataFrame) -> DataFrame:
    """Trials of the functions in both tables (of ``c001`` to ``c100`` if there are any), each with the pairs
    of trials of smaller label before it, as in the order of trials."""
    from ..operators.trials import prefix_examples

    ids = functions_table.select("id").join(stimuli_table.select("id").distinct(), "id", "left_semi")
    standard = ids.where(F.col("id").rlike("^c(0(0[1-9]|[1-9][0-9])|100)$"))
    chosen = standard if not standard.isEmpty() else ids
    return prefix_examples(stimuli_table.join(chosen, "id", "left_semi"), ["id", "order"])


def predictions(spark: SparkSession, path: str, method: str, where: dict[str, object] | None = None) -> DataFrame:
    """A method's rows: id, order, trial, parsed response, program, accuracy, run and its effort columns."""
    rows = table(spark, path, where)
    optional = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    trial = "block_trial" if "block_trial" in rows.columns else "trial"
    return rows.select(
        F.lit(method).alias("method"), "id", F.col("order").cast("int").alias("order"), F.col(trial).cast("int").alias("trial"),
        parsing.response(F.col("response")).alias("response"), optional("program"), parsing.truthy(optional("accuracy")).alias("accuracy"), optional("run"), optional("subject"),
        *[parsing.number(optional(c)).alias(c) for c in EFFORT.get(method, [])],
    )


def join_predictions(trials: DataFrame, rows: DataFrame) -> DataFrame:
    """Every trial with its rows of a method; a trial without a row has no response and is wrong."""
    out = trials.join(rows, ["id", "order", "trial"], "left")
    return out.withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with an array<float> column in place of array archives."""
    return spark.read.parquet(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def config(text: str) -> dict:
    """Settings of an analysis run, as JSON: methods and analyses by registered name, with options."""
    out = json.loads(text)
    for kind in ("methods", "analyses"):
        for entry in out.get(kind, []):
            if "name" not in entry:
                raise ValueError(f"an entry of {kind} has no name")
    return out


class Cache:
    """Results kept at a path named by a hash of what made them; a changed setting is another path."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, settings: dict) -> str:
        return f"{self.folder}/{name}-{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(name, settings)
        if not self._exists(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def fill(self, name: str, settings: dict, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows for all wanted keys: only those not yet kept are made, and are kept from then on."""
        path = self.path(name, settings)
        if self._exists(path):
            missing = wanted.join(self.spark.read.parquet(path).select(*keys), keys, "left_anti")
            make(missing).write.mode("append").parquet(path)
        else:
            make(wanted).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).join(wanted.select(*keys).distinct(), keys, "left_semi")


class Registry:
    """Sources and analyses by name."""

    def __init__(self):
        self.entries: dict[str, Callable] = {}

    def register(self, name: str) -> Callable:
        def keep(f: Callable) -> Callable:
            self.entries[name] = f
            return f

        return keep

    def make(self, name: str, /, **options: object) -> object:
        if name not in self.entries:
            raise ValueError(f"no {name}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name](**options)


METHODS, ANALYSES = Registry(), Registry()
