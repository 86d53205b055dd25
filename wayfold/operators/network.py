"""From ways and their nodes to routing edges, degrees, ends and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.operators.numbering import dealt, numbered


def node_uses(way_nodes: DataFrame, parts: int = 0) -> DataFrame:
    """node, uses (visits by ways, repeats within a way included), ends (visits as a way's first or last node)."""
    last = F.max("pos").over(W.partitionBy("way"))
    marked = way_nodes.withColumn("is_end", ((F.col("pos") == 0) | (F.col("pos") == last)).cast("int"))
    return dealt(marked, parts, "node").groupBy("node").agg(F.count("*").alias("uses"), F.sum("is_end").alias("ends"))


def routing_nodes(way_nodes: DataFrame, parts: int = 0) -> DataFrame:
    """Nodes that are used twice or end a way."""
    return node_uses(way_nodes, parts).where("uses > 1 or ends > 0").select("node")


def way_segments(way_nodes: DataFrame) -> DataFrame:
    """way, pos, node, next_node of each pair of neighbours in a way."""
    following = F.lead("node").over(W.partitionBy("way").orderBy("pos"))
    return way_nodes.withColumn("next_node", following).where("next_node is not null")


def edge_segments(way_nodes: DataFrame, coordinates: DataFrame, parts: int = 0) -> DataFrame:
    """Segments with coordinates and the number of their edge: ways are cut at routing nodes.

    A way with a node that has no coordinates is dropped as a whole. One shuffle by way carries segments, cuts and the
    test for completeness; coordinates and cuts come by joins on node, which Spark broadcasts if they are small. `parts` (here
    and below) is the number of tasks that share large tables, as numbering.shares gives it.
    """
    cuts = routing_nodes(way_nodes, parts).withColumn("is_cut", F.lit(1))
    placed = dealt(way_nodes, parts, "node").join(cuts, "node", "left").join(coordinates.select("node", "x", "y"), "node", "left")
    placed = dealt(placed, parts, "way")
    along = W.partitionBy("way").orderBy("pos")
    whole = F.min(F.col("x").isNotNull().cast("int")).over(W.partitionBy("way"))
    return (
        placed.withColumns(
            {
                "edge": F.sum(F.coalesce("is_cut", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0)) - 1,
                "next_node": F.lead("node").over(along),
                "next_x": F.lead("x").over(along),
                "next_y": F.lead("y").over(along),
                "whole": whole,
            }
        )
        .where("whole = 1 and next_node is not null")
        .select("way", "pos", "edge", "node", "next_node", "x", "y", "next_x", "next_y")
    )


def segment_seconds(metres: Column, limit: Column, average: Column, penalty: Column) -> Column:
    """Travel time of a segment at `average` percent of its speed limit, plus the penalties of both ends."""
    return metres * 3.6 / (limit * average / 100.0) + penalty


def edges(segments: DataFrame, *carried: str) -> DataFrame:
    """One row per edge: source, target, metres, seconds, segments, and columns carried over from its way."""
    return segments.groupBy("way", "edge").agg(
        F.min_by("node", "pos").alias("source"),
        F.max_by("next_node", "pos").alias("target"),
        F.sum("metres").alias("metres"),
        F.sum("seconds").alias("seconds"),
        F.count("*").alias("n_segments"),
        *[F.first(c).alias(c) for c in carried],
    )


def edge_ends(edge_rows: DataFrame) -> DataFrame:
    """Both ends of each edge: node, way, edge, forward (the edge may leave here), backward (it may arrive here).

    edge_rows: source, target, oneway."""
    back = ~F.col("oneway")
    out = F.struct(F.col("source").alias("node"), F.lit(0).alias("side"), F.lit(True).alias("forward"), back.alias("backward"))
    into = F.struct(F.col("target").alias("node"), F.lit(1).alias("side"), back.alias("forward"), F.lit(True).alias("backward"))
    kept = ["way", "edge", *(c for c in edge_rows.columns if c not in ("way", "edge", "source", "target", "oneway"))]
    ends = edge_rows.select(*kept, F.explode(F.array(out, into)).alias("end"))
    return ends.select("end.node", *kept, "end.side", "end.forward", "end.backward")


def degrees(ends: DataFrame) -> DataFrame:
    return ends.groupBy("node").agg(F.sum(F.col("forward").cast("long")).alias("out_degree"), F.sum(F.col("backward").cast("long")).alias("in_degree"))


def end_ids(ends: DataFrame, parts: int = 0) -> DataFrame:
    """Running number of each edge end at its node, two-way edges first."""
    order = W.partitionBy("node").orderBy(F.col("forward") != F.col("backward"), "way", "edge", "side")
    return dealt(ends, parts, "node").withColumn("end_id", (F.row_number().over(order) - 1).cast("int"))


def turns(ends: DataFrame) -> DataFrame:
    """Every way to arrive at a node with every way to leave it; rows grow with in-degree times out-degree of a node."""
    arrive = ends.where("backward").select("node", F.col("way").alias("from_way"), F.col("edge").alias("from_edge"), F.col("side").alias("from_side"))
    leave = ends.where("forward").select("node", F.col("way").alias("to_way"), F.col("edge").alias("to_edge"), F.col("side").alias("to_side"))
    return arrive.join(leave, "node")


def turn_counts(ends: DataFrame, parts: int = 0) -> DataFrame:
    """node, turns, same_way (turns within one way): products of degrees, so no pair of ends is ever made."""
    per_way = dealt(ends, parts, "node").groupBy("node", "way").agg(F.sum(F.col("backward").cast("long")).alias("i"), F.sum(F.col("forward").cast("long")).alias("o"))
    return per_way.groupBy("node").agg((F.sum("i") * F.sum("o")).alias("turns"), F.sum(F.col("i") * F.col("o")).alias("same_way")).where("turns > 0")


def forbidden_turns(ends: DataFrame, restrictions: DataFrame) -> DataFrame:
    """The turns that restrictions (from_way, via, to_way) forbid: each joins the ends that arrive by its first way, then
    those that leave by its second; all other turns are allowed, and never made. `only_` rules are kept out before."""
    rules = restrictions.select("from_way", F.col("via").alias("node"), "to_way").distinct()
    arrive = ends.where("backward").select("node", F.col("way").alias("from_way"), F.col("edge").alias("from_edge"), F.col("side").alias("from_side"))
    leave = ends.where("forward").select("node", F.col("way").alias("to_way"), F.col("edge").alias("to_edge"), F.col("side").alias("to_side"))
    return rules.join(arrive, ["node", "from_way"]).join(leave, ["node", "to_way"])


def restricted(turn_rows: DataFrame, restrictions: DataFrame) -> DataFrame:
    """turns with `forbidden`: a restriction (from_way, via, to_way) forbids them. `only_` rules are kept out before."""
    rules = restrictions.select("from_way", F.col("via").alias("node"), "to_way").distinct().withColumn("forbidden", F.lit(True))
    return turn_rows.join(rules, ["node", "from_way", "to_way"], "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(False)))


def edge_keys(edge_rows: DataFrame, parts: int = 0) -> DataFrame:
    """source, target, way, edge, ordinal (among parallel edges), branching (another way leaves at the target)."""
    out = edge_ends(edge_rows).groupBy("node").agg(F.sum(F.col("forward").cast("long")).alias("out"))
    ordinal = F.row_number().over(W.partitionBy("source", "target").orderBy("way", "edge")) - 1
    back = F.when(F.col("oneway"), 0).otherwise(1)
    rows = dealt(dealt(edge_rows, parts, "source", "target").withColumn("ordinal", ordinal), parts, "target").join(out, F.col("target") == F.col("node"))
    return rows.select("source", "target", "way", "edge", "ordinal", (F.col("out") - back > 1).alias("branching"))


def merge_parallel(edge_rows: DataFrame) -> DataFrame:
    """Edges (source, target, distance, forward, backward) with equal ends and distance become one, directions or-ed."""
    low, high = F.least("source", "target"), F.greatest("source", "target")
    flip = F.col("source") > F.col("target")
    turned = edge_rows.where("source <> target").select(
        low.alias("source"),
        high.alias("target"),
        "distance",
        F.when(flip, F.col("backward")).otherwise(F.col("forward")).alias("forward"),
        F.when(flip, F.col("forward")).otherwise(F.col("backward")).alias("backward"),
    )
    return turned.groupBy("source", "target", "distance").agg(F.bool_or("forward").alias("forward"), F.bool_or("backward").alias("backward"))


def encode(values: DataFrame, column: str, seen: str) -> DataFrame:
    """value, id: ids from 1 by first occurrence (the least `seen`); the empty value is 0 and has no row."""
    first = values.select(F.trim(F.regexp_replace(column, r"\s+", " ")).alias("value"), seen).where("value <> ''").groupBy("value").agg(F.min(seen).alias("first"))
    return numbered(first, [F.asc("first"), F.asc("value")], "id", start=1).select("value", "id")
