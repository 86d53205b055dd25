"""What to tell a driver along a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.functions import geo

# Words for turns by class.
TURNS = {1: "Keep slightly right", 2: "Turn right", 3: "Turn sharply right", -1: "Keep slightly left", -2: "Turn left", -3: "Turn sharply left"}


def ramps(route: DataFrame) -> DataFrame:
    """route with the names of motorway ramps replaced by that of the road after them; a ramp at the very start keeps its."""
    along = W.partitionBy("route").orderBy("pos")
    link = F.col("type") == "motorway_link"
    after = F.first(F.when(~link, F.struct("name")), ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing))
    before = F.max((~link).cast("int")).over(along.rowsBetween(W.unboundedPreceding, -1))
    return route.withColumn("name", F.when(link & (before == 1), F.coalesce(after["name"], F.col("name"))).otherwise(F.col("name")))


def steps(route: DataFrame) -> DataFrame:
    """route, step, type, name, direction, exit, distance, before, whole_before of each step of a route.

    route: route, pos, name, type, branching (another way leaves at the edge's end), seconds, distance, turn (the class of
    the turn into the edge). A step ends where a roundabout begins or ends, the name changes, or the road turns where it
    might go on; `before` are the seconds of the edges before it, `whole_before` those of all edges but the route's last.
    """
    along = W.partitionBy("route").orderBy("pos")
    whole = W.partitionBy("route")
    ring, was = F.col("type") == "roundabout", F.lag("type").over(along) == "roundabout"
    turned = F.lag("branching").over(along) & (F.abs("turn") > 1)
    new = (
        F.when(F.row_number().over(along) == 1, True).when(ring & was, False).when(ring != was, True)
        .otherwise(turned | (F.lag("name").over(along) != F.col("name")))
    )
    marked = ramps(route).withColumns(
        {
            "new": new.cast("int"),
            "direction": F.when((F.row_number().over(along) == 1) | (was & ~ring), 0).otherwise(F.col("turn")),
            "exits": (ring & was & F.lag("branching").over(along)).cast("int"),
            "before": F.coalesce(F.sum("seconds").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "whole_before": F.sum("seconds").over(whole) - F.last("seconds").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )
    numbered = marked.withColumn("step", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)) - 1)
    first = lambda c: F.min_by(c, "pos").alias(c)
    exits = F.when(F.min_by("type", "pos") == "roundabout", 1 + F.sum("exits")).otherwise(0).alias("exit")
    return numbered.groupBy("route", "step").agg(first("type"), first("name"), first("direction"), exits, F.sum("distance").alias("distance"), first("before"), first("whole_before"))


def within(steps_: DataFrame, most_seconds: float) -> DataFrame:
    """The steps that begin within a horizon; the last one of a route only if all edges but the last lie within it."""
    last = F.max("step").over(W.partitionBy("route")) == F.col("step")
    return steps_.withColumn("__last", last).where((F.col("before") < most_seconds) & (~F.col("__last") | (F.col("whole_before") < most_seconds))).drop("__last")


def labels(steps_: DataFrame) -> DataFrame:
    """route, step, labels: the sentences for each step, one or two or none."""
    named = F.col("name") != ""
    words = F.try_element_at(F.create_map(*[F.lit(x) for kv in TURNS.items() for x in kv]), F.col("direction").cast("int"))
    turn = F.when(F.col("direction") != 0, F.concat(words, F.when(named, F.concat(F.lit(" into "), "name")).otherwise(""), F.lit(".")))
    ramp = F.when(named, F.concat(F.lit("Take the ramp towards "), "name", F.lit("."))).otherwise("Take the ramp.")
    head = F.when(F.col("type") == "motorway_link", ramp).otherwise(turn)
    on = F.when(named, F.concat(F.lit("Continue on "), "name", F.lit(" for "))).otherwise("Continue for ")
    go = F.when(F.col("distance") > 20, F.concat(on, geo.distance_text(F.col("distance")), F.lit(".")))
    ring = F.array(F.lit("Enter the roundabout."), F.concat(F.lit("Take the "), F.col("exit").cast("string"), F.lit(". exit.")))
    said = F.when(F.col("exit") > 0, ring).otherwise(F.filter(F.array(head, go), lambda x: x.isNotNull()))
    return steps_.select("route", "step", said.alias("labels"))


def hours_minutes_seconds(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
