"""What the corpus operators share: scratch tables, block bounds, prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Bytes that separate words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where that is unset and all runs in one
    process, as in tests) a temporary folder of this process. Raises on a cluster without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/wayfold-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="wayfold-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return f"file://{_local['dir']}"


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = stash_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stashed = path
    return found


def drop(*stashed: DataFrame | None) -> None:
    """Delete scratch tables, those that stash returned, when nothing unwritten reads them any more."""
    for df in stashed:
        path = getattr(df, "_stashed", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names are never seen."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def word_count(text: Column) -> Column:
    """Number of words of a text (0 for null), inside the JVM."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1
    ).cast("long")


#: Ranges that in_order makes at most; with more rows each holds more, which a task reads in batches.
RANGES = 1 << 15


def in_order(docs: DataFrame, rows_per_part: int, *tie_breaks: str) -> DataFrame:
    """docs dealt out by ranges of doc_id (nulls first) and sorted within each, with the range's number as `part`."""
    parts = min(RANGES, max(1, -(-docs.count() // rows_per_part)))
    order = [F.asc_nulls_first("doc_id"), *tie_breaks]
    return (
        docs.repartitionByRange(parts, F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "*")
    )


def offsets(totals: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """totals with the exclusive running sum of `value`. For tables of one row per block, not per document."""
    window = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def small(stashed: DataFrame, most: int = 50_000) -> DataFrame:
    """A stashed table marked for broadcast if it has `most` rows at most, else as it is."""
    return F.broadcast(stashed) if stashed.count() <= most else stashed


#: A key counts as hot if it has more than this share of all rows, so there are fewer than 1 / HOT hot keys.
HOT = 1 / 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join of rows with table, which has one row for each key and in `n` the number of rows with it (total: of all).

    Hot keys, at most 1 / HOT of them, are broadcast; their rows don't meet in a task. The others join by shuffle. Rows
    without a match, such as those with null keys, are dropped ("inner") or have nulls ("left"). n is kept.
    """
    values = [c for c in table.columns if c not in keys]
    hot = F.col("n") > max(1, int(total * HOT))
    mine = [F.col(k).alias(f"__{k}") for k in keys]
    own = [F.col(c) for c in rows.columns]
    few = F.broadcast(table.where(hot).select(*mine, F.struct(*values).alias("__hot")))
    marked = rows.join(few, [rows[k] == few[f"__{k}"] for k in keys], "left").select(*own, "__hot")
    # Rows of hot keys are dealt by a hash of the whole row, which meets nothing. The others' is no constant, since Spark
    # would take that out of the join's keys.
    deal = F.when(F.col("__hot").isNotNull(), F.xxhash64(*own, F.lit("hot"))).otherwise(F.xxhash64(*keys))
    many = table.where(~hot).select(*keys, F.struct(*values).alias("__cold"), F.xxhash64(*keys).alias("__deal"))
    joined = marked.withColumn("__deal", deal).join(many, [*keys, "__deal"], "left")
    found = F.coalesce("__hot", "__cold")
    joined = joined if how == "left" else joined.where(found.isNotNull())
    return joined.select(*own, *[found[v].alias(v) for v in values])


def batch_rows(spark: SparkSession, rows: int, mb: int = 64) -> None:
    """Rows and megabytes of an Arrow batch handed to Python: few, since texts may be long. Plans read these settings when
    they run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


LONG, INT, DOUBLE, STRING, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])
