"""Reading tables and cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold whole texts here, so Spark's 10,000 rows a batch would make workers large; a lower
    setting stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where a session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name the folder it shares in spark.checkpoint.dir")
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: lost executors cost only their own tasks."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    FOLDERS.append(path)
    out = spark.read.schema(schema).parquet(path)
    out.folder = path
    return out


#: Folders that ``materialize`` has written in this process and ``drop`` has not deleted.
FOLDERS: list[str] = []


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete written tables that nothing will read again, and let Spark do so with its shuffles."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in list(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in FOLDERS:
            FOLDERS.remove(folder)
    if folders:
        jvm.System.gc()  # the driver's cleaner drops shuffles whose plans are gone


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` written; tables that were written after ``FOLDERS`` had ``since`` entries are deleted."""
    out = materialize(df, name)
    drop(df.sparkSession, FOLDERS[since:-1])
    return out


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer where a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id as long and the text, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with their place from 0 in an order, in the column ``name``: sorted ranges are written, and each begins where the
    ones before it end. The driver sees one number for each partition. Rows that tie in the order get places by chance."""
    place = F.monotonically_increasing_id()
    parts = partitions(rows.sparkSession)
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, place), f"{name}-places")
    sizes = placed.groupBy(F.shiftright(name, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at - (p << 33)))
        at += n
    # One row for each partition, whatever the data.
    begin, key = unused("__begin", rows.columns), unused("__part", rows.columns)
    begins = F.broadcast(rows.sparkSession.createDataFrame(before, f"{key} long, {begin} long"))
    return placed.join(begins, F.shiftright(name, 33) == F.col(key), "left").withColumn(name, F.col(name) + F.col(begin)).drop(key, begin)


def with_row(docs: DataFrame, file: str, at: str) -> DataFrame:
    """``docs`` with two numbers (``file``, ``at``) that tell its rows apart in every later reading of it. The rows of files as
    they stand have them already; others are written out first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
