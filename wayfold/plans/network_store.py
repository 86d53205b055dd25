"""From decoded map data to a routing network, stored as Parquet tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.functions import geo
from wayfold.operators import cities, network, tags, turns
from wayfold.operators.numbering import cut, drop, numbered
from wayfold.sources.profiles import SpeedClass

TABLES = ["nodes", "edges", "restrictions", "places", "turns", "addresses"]


class Counters:
    """What an import counts, each number observed by a job that runs anyway. result() gives them after the import."""

    def __init__(self):
        self.seen: list[Observation] = []

    def watch(self, table: DataFrame, **numbers) -> DataFrame:
        found = Observation(f"import-{len(self.seen)}-{id(self)}")
        self.seen.append(found)
        return table.observe(found, *[n.alias(k) for k, n in numbers.items()])

    def result(self) -> dict[str, float | None]:
        return {k: v for o in self.seen for k, v in o.get.items()}


def _count(where=None):
    return F.count(F.lit(1) if where is None else F.when(where, 1))


def _segments(useful: DataFrame, known: DataFrame, in_place: DataFrame, classes: DataFrame, tangential: float, counters: Counters) -> DataFrame:
    """Stored segments of all ways whose nodes are there: way, edge, pos, both ends, metres, speed, seconds, and the way's own
    columns."""
    visits = useful.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))
    crossings = network.routing_nodes(visits).withColumn("is_cut", F.lit(True))
    at = known.select(F.col("id").alias("node"), "lat", "lon", "x", "y", "access", "penalty").join(crossings, "node", "left").join(in_place, "node", "left")
    placed = visits.join(at, "node", "left").withColumn("city", F.col("place").isNotNull())
    along = W.partitionBy("way").orderBy("pos")
    rows = placed.withColumns(
        {
            "whole": F.min(F.col("lat").isNotNull().cast("int")).over(W.partitionBy("way")),
            "edge": F.sum((F.coalesce("is_cut", F.lit(False)) | ~F.col("access")).cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)),
            **{f"next_{c}": F.lead(c).over(along) for c in ("node", "lat", "lon", "x", "y", "access", "penalty", "city")},
        }
    ).where("whole = 1 and next_node is not null")
    own = useful.select(F.col("id").alias("way"), "class", "oneway", "max_speed", "name", "ref", "fixed", "percent")
    rows = rows.join(own, "way").join(F.broadcast(classes), "class")  # the profile's
    points = [F.col(c) for c in ("lat", "lon", "next_lat", "next_lon")]
    tagged = F.when(F.col("max_speed") > 0, F.col("max_speed"))
    by_place = tagged.isNull() & (F.col("city") | F.col("next_city"))
    limit = F.least("limit", F.coalesce(tagged, F.when(by_place, F.col("city_speed")), F.col("limit")))
    rows = rows.withColumns({"metres": F.coalesce(geo.vincenty_m(*points), geo.haversine_m(*points)), "by_place": by_place, "speed": limit * F.col("average") / 100.0 / (1.0 + F.col("percent") / 100.0)})
    rows = turns.segment_speeds(rows, tangential)
    rows = rows.withColumn("seconds", F.col("metres") * 3.6 / F.col("speed") + F.col("fixed") + F.col("penalty") + F.col("next_penalty"))
    return cut(counters.watch(rows, segments=_count(), default_city_speeds=_count(F.col("by_place"))))


def _ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge, as turns.turn_costs takes them."""
    out = F.struct(F.col("source").alias("node"), F.lit(0).alias("side"), F.lit(True).alias("forward"), (~F.col("oneway")).alias("backward"), "first.*")
    into = F.struct(F.col("target").alias("node"), F.lit(1).alias("side"), (~F.col("oneway")).alias("forward"), F.lit(True).alias("backward"), "last.*")
    return edges.select("way", "edge", "class", F.explode(F.array(out, into)).alias("e")).select("way", "edge", "class", "e.*")


def build(
    nodes: DataFrame, ways: DataFrame, relations: DataFrame, profile: tags.Profile, speeds: list[SpeedClass], driving: turns.Driving | None = None, counters: Counters | None = None
) -> dict[str, DataFrame]:
    """The tables of TABLES from raw nodes (id, lat, lon, tags), ways (id, nodes, tags) and relations (id, members, tags), all
    stored.

    nodes: node (dense, by ascending id), id, lat, lon. edges: edge (dense), way, source, target, metres (on the
    ellipsoid), seconds, oneway, class, name, ref, path (points between the ends too). turns: node, from and to (way, edge, side),
    angle, seconds; those that restrictions forbid are left out. addresses: edge, place, name. places: with `outlined` where
    an outline of their name holds them. A node without access cuts its way: every visit gives nodes of its own, so nothing
    passes. Ways with a node that isn't there are dropped whole. Penalties of nodes count at both ends of each segment, the
    fixed seconds of ways once a segment. Without a tagged limit a class has its city_speed where an end of a segment lies
    in a place. Curves limit the speed of a segment by the one before it in its edge.
    """
    spark, driving, counters = nodes.sparkSession, driving or turns.Driving(), counters or Counters()
    classes = spark.createDataFrame([(i, float(s.max_speed), float(s.average), float(s.city_speed)) for i, s in enumerate(speeds)], "class int, limit double, average double, city_speed double")
    decoded = cut(counters.watch(tags.decode_ways(ways, profile), ways=_count(), max_speeds=_count(F.col("max_speed") > 0), zero_speeds=_count(F.col("max_speed") == 0)))
    useful = cut(tags.useful_ways(decoded))
    quantised = {"x": geo.quantise(geo.mercator_x(F.col("lon"))), "y": geo.quantise(geo.mercator_y(F.col("lat")))}
    is_place = F.col("place").isNotNull() & (F.col("name") != "")
    known = cut(counters.watch(tags.decode_nodes(nodes, profile).withColumns(quantised), nodes=_count(), places=_count(is_place)))
    towns = known.where(is_place)
    rules = cut(counters.watch(tags.decode_restrictions(relations, profile), restrictions=_count()))
    counted = cut(counters.watch(relations.select("id"), relations=_count()))
    # Outlines of places: closed ways whose nodes are all there.
    points = tags.outlines(decoded).select("id", "place_name", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    points = points.join(known.select(F.col("id").alias("node"), "x", "y"), "node")
    rings = points.groupBy(F.col("id").alias("outline"), F.col("place_name").alias("name")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("ring"))
    rings = rings.where("size(ring) = n").select("outline", "name", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    rings = cut(counters.watch(rings, outlines=_count()))
    used = useful.select(F.explode("nodes").alias("id")).distinct()
    used = cut(counters.watch(known.join(used, "id", "left_semi").select(F.col("id").alias("node"), "x", "y"), used_nodes=_count()))
    by_kind = towns.select(F.col("id").alias("place"), "name", F.col("place").alias("kind"), "x", "y", geo.units_per_metre(F.col("lat")).alias("scale"))
    in_place = cut(cities.in_city(used, by_kind, rings).select("node", "place"))
    rows = _segments(useful, known, in_place, classes, driving.tangential, counters)
    # A node without access is a new one at each visit: numbers below zero, by way and place.
    fresh = lambda node, access, pos: F.when(F.col(access), F.col(node)).otherwise(-(F.col("way") * 65536 + pos) - 1)
    point = F.struct("pos", F.struct("lat", "lon").alias("p"))
    leaving = F.struct(geo.atan2((F.col("next_y") - F.col("y")).cast("double"), (F.col("next_x") - F.col("x")).cast("double")).alias("angle"), F.col("metres").alias("length"), "speed")
    arriving = F.struct(geo.atan2((F.col("y") - F.col("next_y")).cast("double"), (F.col("x") - F.col("next_x")).cast("double")).alias("angle"), F.col("metres").alias("length"), "speed")
    found = rows.groupBy("way", "edge").agg(
        F.min_by(fresh("node", "access", F.col("pos")), "pos").alias("from_id"), F.max_by(fresh("next_node", "next_access", F.col("pos") + 1), "pos").alias("to_id"),
        F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"), *[F.first(c).alias(c) for c in ("oneway", "class", "name", "ref")],
        F.min_by(leaving, "pos").alias("first"), F.max_by(arriving, "pos").alias("last"),
        F.concat(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]), F.array(F.max_by(F.struct(F.col("next_lat").alias("lat"), F.col("next_lon").alias("lon")), "pos"))).alias("path"),
    )
    found = cut(found)
    ids = found.select(F.col("from_id").alias("id")).union(found.select("to_id")).distinct()
    dense = cut(numbered(ids, [F.asc("id")], "node"))
    coded = found.join(dense.select(F.col("id").alias("from_id"), F.col("node").alias("source")), "from_id").join(dense.select(F.col("id").alias("to_id"), F.col("node").alias("target")), "to_id")
    coded = coded.drop("from_id", "to_id").withColumnRenamed("edge", "part")
    edges = cut(counters.watch(numbered(coded, [F.asc("way"), F.asc("source"), F.asc("target"), F.asc("metres"), F.asc("part")], "edge"), edges=_count()))
    # Addresses and turns know an edge by its way and part.
    key = edges.select("way", "part", "edge")
    lived = cities.addresses(rows, useful.select(F.col("id").alias("way"), "name"), in_place).withColumnRenamed("edge", "part").join(key, ["way", "part"]).select("edge", "place", "name")
    lived = cut(counters.watch(lived, addresses=_count()))
    in_towns = rows.where("city or next_city").select("way", F.col("edge").alias("part")).distinct()
    cut(counters.watch(in_towns, city_edges=_count()))
    forbidden = rules.where("kind = 'no'").join(dense.select(F.col("id").alias("via"), "node"), "via").select("from_way", F.col("node").alias("via"), "to_way")
    ends = cut(_ends(edges))
    kinds = spark.createDataFrame([(i, s.priority, s.pedestrian, float(s.left_penalty), float(s.right_penalty), s.yields_left, s.yields_right, s.yields_straight) for i, s in enumerate(speeds)], "class int, priority int, pedestrian boolean, left_penalty double, right_penalty double, yields_left boolean, yields_right boolean, yields_straight boolean")
    barred = cut(counters.watch(network.forbidden_turns(ends, forbidden), restrictions_applied=_count()))
    costs = turns.turn_costs(ends, kinds, driving).join(barred.select("node", "from_way", "from_edge", "from_side", "to_way", "to_edge", "to_side"), ["node", "from_way", "from_edge", "from_side", "to_way", "to_edge", "to_side"], "left_anti")
    left, right = (F.col("angle") < 0) & (F.col("angle") > -135), (F.col("angle") > 0) & (F.col("angle") < 135)
    mean = lambda where: F.avg(F.when(where, F.col("seconds")))
    costs = cut(counters.watch(costs, turns=_count(), max_turn=F.max("seconds"), mean_left=mean(left), mean_right=mean(right), mean_straight=mean(~(left | right))))
    held = cities.outlined(by_kind, rings.withColumnRenamed("ring", "shape").select("outline", "name", F.col("shape").alias("ring"))).select(F.col("place").alias("id"), F.lit(True).alias("outlined"))
    drop(counted, decoded)
    return {
        "nodes": dense.join(known.select("id", "lat", "lon"), "id", "left").select("node", "id", "lat", "lon"),
        "edges": edges.drop("part", "first", "last"),
        "restrictions": forbidden,
        "places": towns.select("id", "name", "place", "population", "lat", "lon").join(held, "id", "left").na.fill(False, ["outlined"]),
        "turns": costs,
        "addresses": lived,
    }


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Store the tables; edges sorted by source within files, so that a range of nodes is read from few row groups."""
    for name in TABLES:
        table = tables[name]
        (table.sortWithinPartitions("source", "target") if name == "edges" else table).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def graph(edges: DataFrame) -> DataFrame:
    """source, target, cost in tenths of a second, both directions; edges of over 24 hours are left out."""
    rows = edges.where("source <> target").withColumn("cost", F.floor(F.greatest(F.col("seconds") * 10 + 0.5, F.lit(1.0))).cast("long")).where("cost <= 864000")
    back = rows.where("not oneway").select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
    return rows.select("source", "target", "cost").unionByName(back)
