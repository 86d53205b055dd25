"""Vehicles followed along their trips: waypoints passed, leaving the route, and routes anew, as a stateful stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.functions import geo
from wayfold.operators import nearest, routing

EVENTS = "device string, ts timestamp, lat double, lon double, event string, passed int, off_m double"
#: Metres at which a waypoint is reached, and from the route at which a vehicle has left it.
REACHED, OFF = 50.0, 100.0


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Distance on the sphere."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(h))


def off_route(lat: float, lon: float, route: list) -> float:
    """Metres from a point to the nearest place of a route (latitudes and longitudes), taken as plane around the point."""
    scale = (math.radians(1) * geo.EARTH_M * math.cos(math.radians(lat)), math.radians(1) * geo.EARTH_M)
    points = [((b - lon) * scale[0], (a - lat) * scale[1]) for a, b in route]
    best = min((math.hypot(*p) for p in points), default=math.inf)
    for (x, y), (u, v) in zip(points, points[1:]):
        dx, dy = u - x, v - y
        if dx or dy:
            t = min(1.0, max(0.0, -(x * dx + y * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x + t * dx, y + t * dy))
    return best


def follow(fixes: DataFrame, trips: DataFrame, silent_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """EVENTS of a stream of fixes (device, ts, lat, lon) along trips (device, waypoints, route: arrays of lat, lon; one row a
    device; a static table).

    A device's state is how many waypoints it has passed, whether it is off its route, and its last fix. Each fix, in the
    order of time, may give events: `passed` when it comes within REACHED of the next waypoint, `arrived` with the last one,
    `off` when it gets OFF or more from the route, `back` when it returns. `silent` comes when no fix has come for
    silent_seconds of event time. A fix that isn't newer than the state's is ignored, and so are devices without a trip and
    fixes without a time or a place.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [part.split()[0] for part in EVENTS.split(", ")]

    def update(key, batches, state) -> Iterator:
        passed, off, last, lat, lon = state.get if state.exists else (0, False, None, None, None)
        out, seen = [], last
        if state.hasTimedOut:
            out.append((key[0], last, lat, lon, "silent", passed, None))
            state.update((passed, off, last, lat, lon))
        else:
            for r in pd.concat(list(batches)).sort_values("ts", kind="stable").to_dict("records"):
                if seen is not None and r["ts"] <= seen:
                    continue
                seen, lat, lon = r["ts"], r["lat"], r["lon"]
                event = lambda name, d=None: out.append((key[0], r["ts"], lat, lon, name, passed, d))
                points = r["waypoints"]
                if passed < len(points) and metres(lat, lon, points[passed]["lat"], points[passed]["lon"]) < REACHED:
                    passed += 1
                    event("arrived" if passed == len(points) else "passed")
                away = off_route(lat, lon, [(p["lat"], p["lon"]) for p in r["route"]])
                if (away >= OFF) != off:
                    off = not off
                    event("off" if off else "back", round(away, 1) if math.isfinite(away) else None)
            if seen is not None:
                state.update((passed, off, seen, lat, lon))
                state.setTimeoutTimestamp(max(int(seen.timestamp() * 1000) + silent_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    joined = fixes.where("ts is not null and lat is not null and lon is not null").withWatermark("ts", late).join(trips.select("device", "waypoints", "route"), "device")
    own = "passed int, off boolean, last timestamp, lat double, lon double"
    return joined.groupBy("device").applyInPandasWithState(update, EVENTS, own, "append", GroupStateTimeout.EventTimeTimeout)


def reroute(events: DataFrame, trips: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """device, ts, leg, cost, path of the routes from where devices left their route through the waypoints that are left.

    events: rows of follow, of which those named `off` count; nodes: node, lat, lon; graph: source, target, cost. Ends go to
    the nearest node in projected coordinates. Static frames: give it to gps.follow as the answer to a batch of events.
    """
    place = lambda la, lo: (geo.quantise(geo.mercator_x(F.col(lo))), geo.quantise(geo.mercator_y(F.col(la))))
    targets = nodes.select("node", place("lat", "lon")[0].alias("x"), place("lat", "lon")[1].alias("y"))
    left = events.where("event = 'off'").join(trips.select("device", "waypoints"), "device")
    stops = F.concat(F.array(F.struct("lat", "lon")), F.slice("waypoints", F.col("passed") + 1, F.size("waypoints")))
    stops = left.select("device", "ts", F.posexplode(stops).alias("pos", "p")).select("device", "ts", "pos", "p.lat", "p.lon")
    keyed = stops.select(F.xxhash64("device", "ts", "pos").alias("point"), "device", "ts", "pos", place("lat", "lon")[0].alias("px"), place("lat", "lon")[1].alias("py"))
    snapped = keyed.join(nearest.k_nearest(keyed, targets, 1, geo.BITS, ident="node").select("point", "node"), "point")
    along = W.partitionBy("device", "ts").orderBy("pos")
    legs = snapped.select("device", "ts", "pos", F.col("node").alias("origin"), F.lead("node").over(along).alias("target")).where("target is not null")
    legs = legs.withColumn("request", F.xxhash64("device", "ts", "pos"))
    found = routing.routes(graph, legs).select("request", "cost", "path")
    return legs.join(found, "request").select("device", "ts", F.col("pos").alias("leg"), "cost", "path")
