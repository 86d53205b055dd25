"""A road network derived from the driver's tables by fixed rules, the same in Spark and in SQL.

Nodes are parts, with integer coordinates on a grid of 32768 x 32768; ways are orders, through the parts of
its line items; places are nations; positions are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.operators import network, numbering

#: Metres of a grid unit at the equator.
UNIT_M = 1222.99
# Road classes by order priority: limit and average per cent, seconds added at each end of a segment.
CLASSES = [("1-URGENT", 130.0, 90.0, 0.0), ("2-HIGH", 100.0, 85.0, 0.5), ("3-MEDIUM", 70.0, 80.0, 1.0), ("4-NOT SPECIFIED", 50.0, 75.0, 1.5), ("5-LOW", 30.0, 70.0, 2.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        p.alias("node"), ((p * 7919 + s * 104729) % 32768).alias("x"), ((p * 15485863 + s * 32452843) % 32768).alias("y")
    )


def shares(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks share what is as large as the ways' nodes; their number is read from the files' footers."""
    return numbering.shares(table(spark, sf_dir, "lineitem").count())


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = numbering.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), shares(spark, sf_dir), "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), (F.row_number().over(order) - 1).cast("long").alias("pos"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame(CLASSES, "o_orderpriority string, max_speed double, average double, penalty double")
    rows = table(spark, sf_dir, "orders")
    tagged = 30.0 + 10.0 * (F.col("o_custkey") % 10)
    return rows.join(F.broadcast(classes), "o_orderpriority").select(  # five rows
        F.col("o_orderkey").alias("way"), F.least("max_speed", tagged).alias("limit"), "average", "penalty",
        (F.col("o_orderstatus") == "F").alias("oneway"), F.col("o_orderpriority").alias("kind"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.edge_segments(way_nodes(spark, sf_dir), nodes(spark, sf_dir), shares(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(e.alias("point"), ((e * 7919 + u * 104729) % 32768).alias("px"), ((e * 15485863 + u * 32452843) % 32768).alias("py"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with a population (customers), a kind and a grid position."""
    population = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("population"))
    kinds = F.array(*[F.lit(k) for k in ("City", "Town", "Hamlet", "Suburb", "Village", "None")])
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").join(population, "n_nationkey", "left").select(
        k.alias("place"), F.col("n_name").alias("name"), F.coalesce("population", F.lit(0)).alias("population"),
        F.element_at(kinds, (F.col("n_regionkey") % 6 + 1).cast("int")).alias("kind"),
        ((k * 7919 + 104729) % 32768).alias("x"), ((k * 15485863 + 32452843) % 32768).alias("y"), ((k % 4 + 1) * 1500).alias("radius"),
    )


#: The same in SQL, as common table expressions.
SQL = """
nodes AS (SELECT p_partkey AS node, (p_partkey*7919 + p_size*104729) % 32768 AS x, (p_partkey*15485863 + p_size*32452843) % 32768 AS y FROM part),
way_nodes AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
    FROM lineitem),
classes AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {a}, {b}, {c})" for k, a, b, c in CLASSES) + """) AS v(kind, max_speed, average, penalty)),
ways AS (SELECT o_orderkey AS way, least(max_speed, 30.0 + 10.0 * (o_custkey % 10))::DOUBLE AS lim, average::DOUBLE AS average, penalty::DOUBLE AS penalty,
    o_orderstatus = 'F' AS oneway, kind FROM orders JOIN classes ON o_orderpriority = kind),
points AS (SELECT event_id AS point, (event_id*7919 + user_id*104729) % 32768 AS px, (event_id*15485863 + user_id*32452843) % 32768 AS py FROM events),
places AS (SELECT n_nationkey::BIGINT AS place, n_name AS name, coalesce(n, 0) AS population,
    (['City','Town','Hamlet','Suburb','Village','None'])[n_regionkey % 6 + 1] AS kind,
    (n_nationkey::BIGINT*7919 + 104729) % 32768 AS x, (n_nationkey::BIGINT*15485863 + 32452843) % 32768 AS y, ((n_nationkey::BIGINT % 4) + 1) * 1500 AS radius
    FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey),
uses AS (SELECT node, count(*) AS uses, sum((pos = 0 OR pos = last)::INT)::BIGINT AS ends
    FROM (SELECT *, max(pos) OVER (PARTITION BY way) AS last FROM way_nodes) GROUP BY 1),
seg AS (SELECT * FROM (SELECT w.way, w.pos, w.node, lead(w.node) OVER o AS next_node, n.x, n.y, lead(n.x) OVER o AS next_x, lead(n.y) OVER o AS next_y,
    sum(CASE WHEN u.uses > 1 OR u.ends > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w.way ORDER BY w.pos)::BIGINT - 1 AS edge,
    min(CASE WHEN n.x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.way) AS whole
    FROM way_nodes w JOIN uses u USING (node) LEFT JOIN nodes n USING (node) WINDOW o AS (PARTITION BY w.way ORDER BY w.pos))
    WHERE whole = 1 AND next_node IS NOT NULL),
timed AS (SELECT s.*, sqrt((next_x - x)*(next_x - x) + (next_y - y)*(next_y - y)) * 1222.99 AS metres, lim, average, penalty, oneway, kind FROM seg s JOIN ways USING (way)),
edges AS (SELECT way, edge, arg_min(node, pos) AS source, arg_max(next_node, pos) AS target, sum(metres) AS metres,
    sum(metres * 3.6 / (lim * average / 100.0) + 2 * penalty) AS seconds, count(*) AS n_segments, bool_or(oneway) AS oneway, min(kind) AS kind FROM timed GROUP BY 1, 2),
ends AS (SELECT source AS node, way, edge, 0 AS side, true AS forward, NOT oneway AS backward FROM edges
    UNION ALL SELECT target, way, edge, 1, NOT oneway, true FROM edges)
"""
