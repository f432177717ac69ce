"""Methods as sources of predictions and vectors for trials, analyses by name, and a data source of run logs.

A method answers for a whole table of trials at once: ``predict`` gives one row for each trial, ``per_run`` one for each trial and
run, ``embed`` a vector for each trial. What a method cannot do it refuses. Users plug in their own by subclassing
``Method`` and registering it by name; ``RunLog`` is read by ``spark.read.format("run_log")``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions import learning, parsing
from ..operators import trials as R
from . import files
from .files import ANALYSES, METHODS

CELL = ["id", "order", "trial"]


class MissingCapability(Exception):
    """A method is asked for what it does not have."""


class Method:
    """The contract. ``can`` names what a method has: predictions, effort, embeddings."""

    can: frozenset[str] = frozenset()

    def __init__(self, name: str, label: str = ""):
        self.name, self.label = name, label or name

    def _need(self, what: str) -> None:
        if what not in self.can:
            raise MissingCapability(f"{self.name} has no {what}")

    def predict(self, trials: DataFrame) -> DataFrame:
        """``trials`` with response, program, correct, mean_correct and efforts; a trial without rows has no response and is wrong."""
        raise MissingCapability(f"{self.name} has no predictions")

    def per_run(self, trials: DataFrame) -> DataFrame:
        raise MissingCapability(f"{self.name} has no predictions")

    def embed(self, trials: DataFrame) -> DataFrame:
        """``trials`` with a vector each; trials without one go."""
        raise MissingCapability(f"{self.name} has no embeddings")


def _modal(rows: DataFrame, cell: list[str], value: str, place: str) -> DataFrame:
    """Each cell's most frequent value, the first seen of equals: counts, then a maximum, with no list of a cell's rows."""
    counts = rows.groupBy(*cell, value).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__p"))
    return counts.groupBy(*cell).agg(F.max_by(F.struct(value), F.struct("__n", -F.col("__p"))).alias("__v")).select(*cell, F.col(f"__v.{value}").alias(value))


class TableMethod(Method):
    """Predictions kept as rows (id, order, trial, place, response as ``parsing.response``, program, score, run, efforts), several for
    a trial; ``place`` is their order."""

    can = frozenset({"predictions", "effort"})

    def __init__(self, name: str, rows: DataFrame, efforts: tuple[str, ...] = (), label: str = ""):
        super().__init__(name, label)
        self.rows, self.efforts = rows, efforts

    def _folded(self, rows: DataFrame, cell: list[str]) -> DataFrame:
        means = [F.avg(c).alias(c) for c in self.efforts]
        out = rows.groupBy(*cell).agg(F.avg("score").alias("mean_correct"), *means)
        for value in ("response", "program"):
            out = out.join(_modal(rows, cell, value, "place"), cell)
        return out

    def predict(self, trials: DataFrame) -> DataFrame:
        out = trials.join(self._folded(self.rows, CELL), CELL, "left")
        return out.withColumn("correct", F.coalesce(F.col("mean_correct") >= 0.5, F.lit(False)))

    def per_run(self, trials: DataFrame) -> DataFrame:
        folded = self._folded(self.rows.withColumn("run", F.coalesce("run", F.lit("1"))), [*CELL, "run"])
        return trials.join(folded, CELL).withColumn("correct", F.col("mean_correct") >= 0.5)


class VectorMethod(TableMethod):
    """A table method with vectors (id, order, trial, embedding) beside it."""

    can = frozenset({"predictions", "effort", "embeddings"})

    def __init__(self, name: str, rows: DataFrame, vectors: DataFrame, efforts: tuple[str, ...] = (), label: str = ""):
        super().__init__(name, rows, efforts, label)
        self.vectors = vectors

    def embed(self, trials: DataFrame) -> DataFrame:
        return trials.join(self.vectors.select(*CELL, "embedding"), CELL)


def csv_rows(spark: SparkSession, path: str, efforts: tuple[str, ...] = (), where: dict[str, object] | None = None, response: str = "response", score: str | None = "accuracy") -> DataFrame:
    """Rows of a ``TableMethod`` from a CSV table."""
    rows = files.table(spark, path, where).withColumn("place", F.monotonically_increasing_id())
    text = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    trial = "block_trial" if "block_trial" in rows.columns else "trial"
    effort = [F.when(F.coalesce(text(c), F.lit("")) != "", parsing.number(text(c))).alias(c) for c in efforts]
    truth = parsing.truthy(text(score)) if score else F.lit(0.0)
    return rows.select(
        "id", F.col("order").cast("int").alias("order"), F.col(trial).cast("int").alias("trial"), "place", parsing.response(text(response)).alias("response"),
        text("program").alias("program"), truth.alias("score"), text("run").alias("run"), *effort,
    )


def _register_tables() -> None:
    kinds = files.EFFORT | {"mpl_best": ["time", "count", "lposterior"], "human": []}

    def maker(kind: str, efforts: tuple[str, ...]) -> Callable:
        answer, score = ("output", None) if kind == "mpl_best" else ("response", "accuracy")

        def make(spark: SparkSession, path: str, name: str = kind, label: str = "", where: dict[str, object] | None = None) -> Method:
            return TableMethod(name, csv_rows(spark, path, efforts, where, answer, score), efforts, label)

        return make

    for kind, efforts in kinds.items():
        METHODS.register(kind)(maker(kind, tuple(efforts)))


_register_tables()


@METHODS.register("table")
def _table(rows: DataFrame, name: str = "table", label: str = "", efforts: tuple[str, ...] = (), vectors: DataFrame | None = None) -> Method:
    return TableMethod(name, rows, efforts, label) if vectors is None else VectorMethod(name, rows, vectors, efforts, label)


# Analyses, by the names of a configuration.


@ANALYSES.register("rule_acquisition")
def _rule_acquisition(trials: DataFrame, keys: list[str]) -> DataFrame:
    return R.acquisition(trials, keys)


@ANALYSES.register("failure_modes")
def _failure_modes(per_task: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    return R.feature_accuracy(R.feature_rows(per_task, features, names))


@ANALYSES.register("clustering")
def _clustering(rows: DataFrame, column: str, choices: list[int], features: list[str]) -> DataFrame:
    return learning.enrichment(learning.cluster(rows, column, choices)[0], features)


@ANALYSES.register("error_similarity")
def _error_similarity(methods: DataFrame, humans: DataFrame, cell: list[str]) -> DataFrame:
    return R.error_similarity(methods, humans, cell)


@ANALYSES.register("probing")
def _probing(rows: DataFrame, column: str, label: str, key: str, n_perm: int = 0) -> DataFrame:
    """AUROC by fold as permutation -1, and those of the null from 0 on."""
    own = learning.probe(rows, column, label, key).withColumn("perm", F.lit(-1))
    return own if not n_perm else own.unionByName(learning.probe_null(rows, column, label, key, n_perm))


# Run logs.


class RunFile(InputPartition):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run


class RunLog(DataSource):
    """What runs have logged: a folder with one JSON-lines file, or a folder ``run=<name>`` of such files, for each run; records have
    step, key and value. Runs are partitions, and an equality on ``run`` opens only that run's files."""

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return "run string, step long, key string, value double"

    def reader(self, schema: object) -> DataSourceReader:
        return RunLogReader(self.options["path"])

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(cls)


class RunLogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.run = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities on the run; all others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("run",) and self.run in (None, f.value):
                self.run = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or not info.path.endswith((".json", ".jsonl")) or parts[-1].startswith(("_", ".")):
                continue
            run = parts[0].removeprefix("run=") if len(parts) > 1 else parts[0].rsplit(".", 1)[0]
            if self.run in (None, run):
                found.append(RunFile(info.path, run))
        return found

    def read(self, partition: RunFile | None) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs, json

        if partition is None:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        kinds = pa.schema([("step", pa.int64()), ("key", pa.string()), ("value", pa.float64())])
        with store.open_input_stream(partition.path) as stream:
            data = stream.read()
        if not data.strip():
            return
        table = json.read_json(pa.BufferReader(data), parse_options=json.ParseOptions(explicit_schema=kinds, unexpected_field_behavior="ignore"))
        run = pa.array([partition.run] * table.num_rows, pa.string())
        yield from pa.table([run, *(table.column(c) for c in kinds.names)], ["run", *kinds.names]).to_batches()
