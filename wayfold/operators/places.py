"""Place and street names: importance, lengths, suggestions, implied tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.operators.numbering import numbered

# Rank of place types among places of equal population.
TYPE_RANKS = {"City": 6, "Town": 5, "Village": 4, "Hamlet": 3, "Suburb": 0, "None": 0}


def type_rank(kind: Column) -> Column:
    out = F.lit(0)
    for name, rank in TYPE_RANKS.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def importance(places: DataFrame) -> DataFrame:
    """places (place, name, population, kind) with their rank from 0: population, then type, then name, all ascending."""
    ranked = places.withColumn("type_rank", type_rank(F.col("kind")))
    return numbered(ranked, [F.asc(c) for c in ("population", "type_rank", "name", "place")], "importance").drop("type_rank")


def suggest(named: DataFrame, prefix: str, amount: int) -> DataFrame:
    """The `amount` most important names that begin with prefix in any case; a top-k, so no full sort."""
    wanted = named.where(F.startswith(F.lower("name"), F.lit(prefix.lower())))
    return wanted.groupBy("name").agg(F.max("importance").alias("importance")).orderBy(F.desc("importance"), "name").limit(amount)


def next_characters(named: DataFrame, prefix: str) -> DataFrame:
    """next_char, n: how names that begin with prefix go on."""
    low = F.lower("name")
    wanted = named.where(F.startswith(low, F.lit(prefix.lower())) & (F.length("name") > len(prefix)))
    return wanted.groupBy(F.substring(low, len(prefix) + 1, 1).alias("next_char")).agg(F.countDistinct("name").alias("n")).orderBy("next_char")


def street_lengths(streets: DataFrame) -> DataFrame:
    """Length of each street of a place and its rank there, the shortest first."""
    total = streets.groupBy("place", "street").agg(F.sum("length").alias("length"))
    order = W.partitionBy("place").orderBy("length", "street")
    return total.withColumn("importance", (F.row_number().over(order) - 1).cast("long"))


def implications(rows: DataFrame) -> DataFrame:
    """From rows (key, value, implies: 'k=v,k=v;..') the implied tags of each tag that don't contradict another row."""
    item = F.explode(F.split("implies", "[,;]"))
    split = rows.select("key", "value", item.alias("item")).select("key", "value", F.split(F.trim("item"), "=").alias("kv")).where("size(kv) = 2")
    pairs = split.select("key", "value", F.trim(F.get("kv", F.lit(0))).alias("implied_key"), F.trim(F.get("kv", F.lit(1))).alias("implied_value")).distinct()
    found = pairs.groupBy("key", "value", "implied_key").agg(F.count("*").alias("n"), F.min("implied_value").alias("implied_value"))
    return found.where("n = 1").drop("n")
