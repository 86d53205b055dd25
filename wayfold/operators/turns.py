"""Speeds in curves and the cost of turns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass
class Driving:
    """Accelerations in m/s2, speeds in km/h past pedestrians and other cars."""

    tangential: float = 1.5
    acceleration: float = 1.5
    deceleration: float = 2.0
    pedestrian: float = 7.0
    other_cars: float = 10.0


def curve_speed(metres: Column, dx: Column, dy: Column, last_dx: Column, last_dy: Column, tangential: float) -> Column:
    """Speed limit in km/h at the start of a segment, from the radius of the curve with the segment before it; null for none.
    Radii of up to 2.5 m and from 1000 m on set no limit."""
    half = (F.atan2(last_dy, last_dx) - F.atan2(-dy, -dx)) / 2.0
    radius = F.abs(F.sin(half) / F.cos(half)) * metres / 2.0
    return F.when((radius > 2.5) & (radius < 1000), F.sqrt(tangential * radius) * 3.6)


def segment_speeds(segments: DataFrame, tangential: float) -> DataFrame:
    """segments (way, edge, pos, x, y, next_x, next_y, metres, speed) with the speed that curves within their edge allow."""
    along = W.partitionBy("way", "edge").orderBy("pos")
    rows = segments.withColumns({"__dx": (F.col("next_x") - F.col("x")).cast("double"), "__dy": (F.col("next_y") - F.col("y")).cast("double")})
    limit = curve_speed(F.col("metres"), F.col("__dx"), F.col("__dy"), F.lag("__dx").over(along), F.lag("__dy").over(along), tangential)
    return rows.withColumn("__limit", limit).withColumn("speed", F.least("speed", F.coalesce("__limit", F.col("speed")))).drop("__dx", "__dy", "__limit")


def angle_between(from_angle: Column, to_angle: Column) -> Column:
    """Degrees from -180 to 180 between two edges that leave a node at these angles: 0 is straight on, below it is left."""
    return ((from_angle - to_angle) / math.pi * 180.0 + 360.0) % 360.0 - 180.0


def turn_costs(ends: DataFrame, classes: DataFrame, driving: Driving | None = None) -> DataFrame:
    """Seconds that each turn at a node costs: node, from and to (way, edge, side), angle, seconds.

    ends: node, way, edge, side, forward, backward, class, angle, length, speed. classes (class, priority, pedestrian,
    left_penalty, right_penalty, yields_left, yields_right, yields_straight) are few and broadcast. A turn slows down to
    what its radius, pedestrians and crossing traffic of a higher priority allow; rows grow with in- times out-degree.
    """
    driving = driving or Driving()
    busy = ends.where("backward").groupBy("node", "class").agg(F.count("*").alias("n")).join(F.broadcast(classes.select("class", "priority")), "class")
    busy = busy.groupBy("node").agg(F.collect_list(F.struct("priority", "n")).alias("arriving"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("way", "edge", "side", "class", "angle", "length", "speed", "backward")]
    named = lambda p: classes.select(*[F.col(c).alias(f"{p}_{c}") for c in classes.columns])
    pairs = ends.where("backward").select("node", *side("from")).join(ends.where("forward").select("node", *side("to")), "node").join(busy, "node")
    pairs = pairs.join(F.broadcast(named("from")), "from_class").join(F.broadcast(named("to")), "to_class")
    angle = angle_between(F.col("from_angle"), F.col("to_angle"))
    pairs = pairs.withColumn("angle", angle)
    left = (F.col("angle") < 0) & (F.col("angle") > -135)
    right = (F.col("angle") > 0) & (F.col("angle") < 135)
    half = F.radians(F.abs("angle")) / 2
    radius = F.sin(half) / F.cos(half) * F.least(F.lit(5.0), "from_length", "to_length") / 2.0
    speed = F.least("from_speed", "to_speed")
    speed = F.when(radius < 1000, F.least(speed, F.sqrt(driving.tangential * radius) * 3.6)).otherwise(speed)
    speed = F.when(F.col("to_pedestrian") & (F.abs("angle") < 135), F.least(speed, F.lit(driving.pedestrian))).otherwise(speed)
    above = F.aggregate("arriving", F.lit(0).cast("long"), lambda a, x: a + F.when(x["priority"] > F.col("from_priority"), x["n"]).otherwise(0))
    others = above - ((F.col("to_class") > F.col("from_class")) & F.col("to_backward")).cast("int")
    yields = F.when(left, F.col("from_yields_left")).when(right, F.col("from_yields_right")).otherwise(F.col("from_yields_straight"))
    speed = F.when(yields & (others >= 1), F.least(speed, F.lit(driving.other_cars))).otherwise(speed)
    pairs = pairs.withColumn("at", speed)
    lost = lambda v, a: F.pow(F.col(v) - F.col("at"), 2) / (2.0 * F.col(v) * a * 3.6)
    extra = F.when(left, F.col("to_left_penalty")).when(right, F.col("to_right_penalty")).otherwise(0.0)
    seconds = lost("from_speed", driving.deceleration) + lost("to_speed", driving.acceleration) + extra
    kept = ["node", *(f"{p}_{c}" for p in ("from", "to") for c in ("way", "edge", "side")), "angle"]
    return pairs.select(*kept, F.when((F.col("from_speed") > 0) & (F.col("to_speed") > 0), seconds).otherwise(0.0).alias("seconds"))


def turn_averages(costs: DataFrame) -> DataFrame:
    """node, turns, and mean cost of turns to the left, to the right and straight on, and the greatest cost."""
    left = (F.col("angle") < 0) & (F.col("angle") > -135)
    right = (F.col("angle") > 0) & (F.col("angle") < 135)
    mean = lambda where, name: F.round(F.avg(F.when(where, F.col("seconds"))), 4).alias(name)
    return costs.groupBy("node").agg(
        F.count("*").alias("turns"), mean(left, "left"), mean(right, "right"), mean(~(left | right), "straight"), F.round(F.max("seconds"), 4).alias("most")
    )
