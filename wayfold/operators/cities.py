"""Which place a node lies in, addresses, and streets by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import spatial

# Metres around places without an outline that count as within them.
RADII = {"Hamlet": 300, "Village": 1000, "Town": 5000, "City": 10000}


def outlined(places: DataFrame, outlines: DataFrame) -> DataFrame:
    """place, ring: of the outlines (outline, name, ring) of a place's name that hold the place, the first."""
    o = outlines.select(F.col("name").alias("__name"), "outline", "ring")
    held = places.join(o, places["name"] == o["__name"]).where(geo.in_polygon(F.col("x"), F.col("y"), F.col("ring")))
    return held.groupBy("place").agg(F.min_by("ring", "outline").alias("ring"))


def in_city(nodes: DataFrame, places: DataFrame, outlines: DataFrame, radii: dict[str, float] | None = None) -> DataFrame:
    """node, place, inside of the nodes (node, x, y) in a place (place, name, kind, x, y): the last by number of those whose
    outline holds it; else the nearest of the places without an outline, within the radius of its kind, then the first.
    Suburbs without an outline hold nothing. Where places have a `scale`, radii are times that."""
    points = nodes.select(F.col("node").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    rings = outlined(places, outlines)
    inside = spatial.containing(points, rings.withColumnRenamed("place", "ring_id")).groupBy("point").agg(F.max("ring_id").alias("ring_id"))
    radius = F.try_element_at(F.create_map(*[F.lit(x) for kv in (radii or RADII).items() for x in kv]), "kind")
    radius = radius * F.col("scale") if "scale" in places.columns else radius
    open_ = places.join(rings.select("place"), "place", "left_anti").withColumn("radius", radius).where("radius is not null")
    near = spatial.nearest_place(points, open_.select("place", "x", "y", "radius"))
    both = inside.join(near, "point", "full_outer")
    return both.select(F.col("point").alias("node"), F.coalesce("ring_id", "place").alias("place"), F.col("ring_id").isNotNull().alias("inside"))


def addresses(segments: DataFrame, names: DataFrame, cities: DataFrame) -> DataFrame:
    """way, edge, place, name: each place that a node of a named edge lies in, once. segments: way, edge, node, next_node;
    names: way, name."""
    ends = segments.select("way", "edge", F.explode(F.array("node", "next_node")).alias("node")).distinct()
    at = ends.join(cities.select("node", "place"), "node").select("way", "edge", "place").distinct()
    return at.join(names.where("name <> ''"), "way").select("way", "edge", "place", "name")


def streets(addresses_: DataFrame, lengths: DataFrame) -> DataFrame:
    """place, name, n_edges, metres of every street of a place."""
    return addresses_.join(lengths.select("way", "edge", "metres"), ["way", "edge"]).groupBy("place", "name").agg(F.count("*").alias("n_edges"), F.sum("metres").alias("metres"))


def suggest_streets(streets_: DataFrame, place: int, prefix: str, amount: int) -> DataFrame:
    """The longest streets of a place whose names begin with prefix in any case; a top-k."""
    wanted = streets_.where((F.col("place") == place) & F.startswith(F.lower("name"), F.lit(prefix.lower())))
    return wanted.orderBy(F.desc("metres"), "name").limit(amount)
