"""Tables in the folder that a cluster shares, and places in a global order without one task that sorts everything."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name the folder it shares in spark.checkpoint.dir")
    return (folder or "/tmp/checkpoints").rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out over as many tasks as a shuffle has: a table in one small file is one task, however much a row costs."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor costs its own tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with their place (from 0) in an order: ranges are sorted in partitions and written, and each partition starts where
    the ones before it end. The driver sees one number for each partition. The order should be total."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "places")
    sizes = placed.groupBy(F.shiftright(name, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at - (p << 33)))
        at += n
    # One row for each partition, whatever the data.
    begins = F.broadcast(spark.createDataFrame(before, "__part long, __begin long"))
    return placed.join(begins, F.shiftright(name, 33) == F.col("__part"), "left").withColumn(name, F.col(name) + F.col("__begin")).drop("__part", "__begin")


def running_total(rows: DataFrame, name: str, value: str, *order: str | Column) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows before in an order: sums within sorted ranges, and the sum of the
    ranges before."""
    placed = numbered(rows, "__place", *order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = placed.count() // parts + 1
    block = (F.col("__place") / width).cast("long")
    sums = placed.groupBy(block.alias("__block")).agg(F.sum(value).alias("n")).orderBy("__block").collect()
    before, at = [], 0
    for b, n in sums:
        before.append((b, at))
        at += n or 0
    kind = "double" if isinstance(at, float) else "long"
    begins = F.broadcast(rows.sparkSession.createDataFrame(before, f"__block long, __begin {kind}"))
    from pyspark.sql import Window

    own = F.sum(value).over(Window.partitionBy("__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("__block", block).join(begins, "__block", "left").withColumn(name, F.col("__begin") + F.coalesce(own, F.lit(0)))
    return out.drop("__block", "__begin", "__place")
