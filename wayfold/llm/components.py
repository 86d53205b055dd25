"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import common

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Each star is an aggregate and a join by node in which nodes of many edges are spread over tasks; no component is
    gathered anywhere. Ends when a round changes nothing, after about the logarithm of the longest path; raises after ROUNDS. No
    edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = common.stash(pairs, "star")
    size = state.count()
    before = old = None
    for _ in range(ROUNDS):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = common.join_counted(both.where("v > u"), least, ["u"], 2 * size)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stash(large, "star")
        common.drop(old)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_counted(large, least, ["u"], size).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, state = state, common.stash(small, "star")
        common.drop(large)
        now = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        size = now[0]
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
