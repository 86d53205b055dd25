"""Reliable cuts of lineage, and running numbers over whole tables without a task that sees them all."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


_local: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, as in tests, in a temporary folder if all
    runs in one process; on a cluster that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="wayfold-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        folder = f"file://{_local[0]}"
    return f"{folder.rstrip('/')}/wayfold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a large table that a task takes: sorts and maps of that many stay within some 200 MB.
TASK_ROWS = 500_000


def shares(rows: int) -> int:
    """How many tasks share a table of that many rows; 0 where it is small and Spark's own number does."""
    return math.ceil(rows / TASK_ROWS) if rows > 8 * TASK_ROWS else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df by keys in at least `parts` parts, which adaptive execution doesn't join again: it goes by compressed bytes, of which
    a task's memory is many times as much. As it is for 0 parts."""
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if parts else df


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: df is written once, as a table in the shared folder, and read back."""
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._cut = path
    return found


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark doesn't broadcast: it goes by the bytes of compressed files, of which the rows in the
    driver's memory are many times as many, and doesn't count what an explode makes of them."""
    return df.hint("merge")


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut has written, when nothing unwritten reads them any more."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with the place of each row in `order`, from `start`: ranges are sorted and numbered on their own, and begin where
    the counts of those before them end. The counts are one row a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    ends = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    placed = ranged.join(F.broadcast(ends.select("__part", before.alias("__before"))), "__part")  # a row a range
    return placed.withColumn(name, (own + F.col("__before") + F.lit(start - 1)).cast("long")).drop("__part", "__before")
