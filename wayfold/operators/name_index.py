"""A stored index of names: what each beginning of a name can go on to, answered from one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prefixes(named: DataFrame, k: int = 10) -> DataFrame:
    """prefix (lower case), n, best (up to k of name, importance, id), continuation of every beginning of a name, "" too.

    named: id, name, importance. best are the most important names, ties by name, each with its greatest importance and
    the least id that has it; n counts the names; continuation is what all names of the prefix have next in common (lower
    case). Names that are null or empty are left out. A prefix of many names is cut to k of them before the shuffle.
    """
    names = named.where("name <> ''").groupBy("name").agg(F.max(F.struct("importance", (-F.col("id")).alias("id"))).alias("m"))
    names = names.select("name", F.lower("name").alias("low"), "m.importance", (-F.col("m.id")).alias("id"))
    rows = names.select("*", F.explode(F.sequence(F.lit(0), F.length("low"))).alias("size"))
    rows = rows.withColumn("prefix", F.expr("substr(low, 1, size)"))
    first = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("importance"), "name"))
    top = rows.withColumn("k", first).where(F.col("k") <= k).groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("k", F.struct("name", "importance", "id").alias("v")))).alias("best"))
    ends = rows.groupBy("prefix").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("low").alias("high"))
    # What the first and the last name in order have in common, all have.
    common = F.expr("array_max(filter(sequence(0, length(low)), i -> substr(low, 1, i) = substr(high, 1, i)))")
    continuation = F.expr("substr(low, length(prefix) + 1, common - length(prefix))")
    ends = ends.withColumn("common", common).select("prefix", "n", continuation.alias("continuation"))
    return ends.join(top, "prefix").select("prefix", "n", F.col("best.v").alias("best"), "continuation")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def write(named: DataFrame, path: str, k: int = 10, buckets: int = 64) -> None:
    """Store prefixes(named) and named itself by id, each in `buckets` folders of one file, sorted by its key."""
    found = prefixes(named, k)
    for name, table, key in (("prefixes", found, "prefix"), ("ids", named.where("id is not null"), "id")):
        dealt = table.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def _one(spark: SparkSession, path: str, table: str, key: str, value: Column, buckets: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.where((F.col("bucket") == _bucket(value, buckets)) & (F.col(key) == value)).drop("bucket")


def suggest(spark: SparkSession, path: str, prefix: str, buckets: int = 64) -> DataFrame:
    """name, importance, id of the best names that begin with prefix in any case, the best first, from one stored file."""
    found = _one(spark, path, "prefixes", "prefix", F.lit(prefix.lower()), buckets)
    return found.select(F.posexplode("best").alias("k", "b")).orderBy("k").select("b.*")


def continuation(spark: SparkSession, path: str, prefix: str, buckets: int = 64) -> DataFrame:
    """n, continuation of a prefix, from one stored file."""
    return _one(spark, path, "prefixes", "prefix", F.lit(prefix.lower()), buckets).select("n", "continuation")


def by_id(spark: SparkSession, path: str, ident: int, buckets: int = 64) -> DataFrame:
    """All that is stored of the named row with an id, from one file."""
    return _one(spark, path, "ids", "id", F.lit(ident).cast("long"), buckets)
