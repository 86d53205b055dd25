"""Readers of map extracts, plain graphs, tracks and profiles, as DataFrames."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.pbf import osm_pbf

_TAG = "tag array<struct<_k: string, _v: string>>"
_SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref: long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type: string, _ref: long, _role: string>>, {_TAG}",
}


def osm_xml(spark: SparkSession, path: str, entity: str, keys: list[str] | None = None) -> DataFrame:
    """Nodes, ways or relations of an .osm or .osm.bz2 file; tags stay arrays, since their order matters. With keys,
    only tags of these are kept."""
    rows = spark.read.format("xml").option("rowTag", entity).schema(_SCHEMAS[entity]).load(path)
    tags = F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    if keys is not None:
        tags = F.filter(tags, lambda t: t["k"].isin(keys))
    own = {
        "node": [F.col("_lat").alias("lat"), F.col("_lon").alias("lon")],
        "way": [F.transform(F.coalesce("nd", F.array()), lambda n: n["_ref"]).alias("nodes")],
        "relation": [F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members")],
    }[entity]
    return rows.select(F.col("_id").alias("id"), *own, tags.alias("tags"))


def ddsg(spark: SparkSession, path: str) -> DataFrame:
    """source, target, distance, forward, backward of a plain graph: 'd', 'n m', then rows 'from to weight direction',
    0 both ways, 1 forward, 2 backward, 3 closed. Closed edges and loops are dropped."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(part) == 4).select(*[F.get(part, F.lit(i)).cast("long").alias(c) for i, c in enumerate(("source", "target", "distance", "direction"))])
    kept = rows.where("direction < 3 and source <> target")
    return kept.select("source", "target", "distance", F.col("direction").isin(0, 1).alias("forward"), F.col("direction").isin(0, 2).alias("backward"))


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """segment, pos, lat, lon, ele, time of each point of a GPX track."""
    point = "struct<_lat: double, _lon: double, ele: double, time: timestamp>"
    rows = spark.read.format("xml").option("rowTag", "trk").schema(f"trkseg array<struct<trkpt: array<{point}>>>").load(path)
    segments = rows.select(F.posexplode("trkseg").alias("segment", "s"))
    points = segments.select("segment", F.posexplode("s.trkpt").alias("pos", "p"))
    return points.select("segment", "pos", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), "p.ele", "p.time")


def profile(spark: SparkSession, text: str) -> DataFrame:
    """Road classes of a speed profile in INI form: one section per class, one row each."""
    parsed = configparser.ConfigParser()
    parsed.read_string(text)
    rows = [(s, i, float(parsed[s]["max_speed"]), float(parsed[s]["average"]), float(parsed[s].get("penalty", "0"))) for i, s in enumerate(parsed.sections())]
    return spark.createDataFrame(rows, "class string, position int, max_speed double, average double, penalty double")


def osm(spark: SparkSession, path: str, entity: str, keys: list[str] | None = None) -> DataFrame:
    """Nodes, ways or relations of a map extract, by the suffix of its name: .osm, .osm.bz2 or .pbf."""
    if path.endswith(".pbf"):
        return osm_pbf(spark, path.removeprefix("file://"), entity, keys)
    if path.endswith((".osm", ".osm.bz2")):
        return osm_xml(spark, path, entity, keys)
    raise ValueError(f"no reader for {path}")


def write_gpx(track: DataFrame, path: str) -> None:
    """A track (track, segment, pos, lat, lon, ele, time) as GPX: a file of a row a track, in any number of files. A track's
    points meet in one task, as they do in the file."""
    ele = F.when(F.col("ele").isNotNull() & ~F.isnan("ele"), F.format_string("<ele>%s</ele>", "ele")).otherwise("")
    point = F.concat(F.format_string('<trkpt lat="%s" lon="%s">', "lat", "lon"), ele, F.format_string("<time>%s</time></trkpt>", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    rows = track.select("track", "segment", "pos", point.alias("point")).groupBy("track", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "point"))).alias("points"))
    segment = F.concat(F.lit("<trkseg>"), F.array_join(F.transform("points", lambda p: p["point"]), ""), F.lit("</trkseg>"))
    tracks = rows.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("segment", segment.alias("text")))).alias("segments"))
    text = F.concat(F.lit('<gpx version="1.1"><trk>'), F.array_join(F.transform("segments", lambda s: s["text"]), ""), F.lit("</trk></gpx>"))
    tracks.select(text.alias("value")).write.text(path)
