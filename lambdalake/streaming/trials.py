"""Running trial counts from a stream of events, and acquisition kept up batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trials import TRIALS, acquisition, from_events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_accuracy(events: DataFrame, threshold: float = 40.0, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Share of correct events by type and window of time; events later than ``late`` are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > threshold).cast("int")).alias("accuracy")).select("window.start", "event_type", "n", "accuracy")


def _folder(spark: SparkSession, folder: str) -> tuple[object, object]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables below a folder that were written to their end."""
    path, files = _folder(spark, folder)
    if not files.exists(path):
        return []
    names = [str(x.getPath().toString()) for x in files.listStatus(path)]
    return sorted(int(n.rsplit("=", 1)[1]) for n in names if "/version=" in n and files.exists(_folder(spark, f"{n}/_SUCCESS")[0]))


def acquired(spark: SparkSession, folder: str) -> DataFrame:
    """The acquisition table of the last batch that is whole; a batch under way is not seen."""
    return spark.read.parquet(f"{folder}/acquired/version={versions(spark, f'{folder}/acquired')[-1]}")


def acquisition_writer(folder: str, threshold: float = 40.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps acquisition up.

    Acquisition rests on the first trials of each (type, user), so these events are the whole state: a batch reads the state
    of the one before and its own events, never all earlier ones, and late events take the place that they would have had.
    State and table get the batch's number, so a repeated batch overwrites itself; the last but one stays for readers."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.select("event_id", "ts", "user_id", "event_type", "value")
        before = [n for n in versions(spark, f"{folder}/first") if n < number]
        if before:
            events = spark.read.schema(events.schema).parquet(f"{folder}/first/version={before[-1]}").unionByName(events)
        turn = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
        state = f"{folder}/first/version={number}"
        events.withColumn("turn", turn).where(F.col("turn") <= TRIALS).drop("turn").write.mode("overwrite").parquet(state)
        trials = from_events(spark.read.schema(events.schema).parquet(state), threshold)
        acquisition(trials, ["method", "function"]).write.mode("overwrite").parquet(f"{folder}/acquired/version={number}")
        for name in ("first", "acquired"):
            for old in [n for n in versions(spark, f"{folder}/{name}") if n < number][:-1]:
                path, files = _folder(spark, f"{folder}/{name}/version={old}")
                files.delete(path, True)

    return write
