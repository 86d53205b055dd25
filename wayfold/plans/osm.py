"""Queries on tagged map data, derived from the driver's tables by fixed rules, each with the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import cities, instructions, network, tags, tiles, turns
from wayfold.operators.numbering import cut
from wayfold.plans import road, tables
from wayfold.plans.road import ORACLES, QUERIES, query  # noqa: F401  the same registry

PROFILE = tags.Profile(
    classes=["motorway", "motorway_link", "primary", "residential"],
    languages=["name:de", "name"],
    way_modifiers=[("surface", "gravel", "percent", -20), ("surface", None, "fixed", 2), ("tunnel", "yes", "percent", 15), ("toll", "yes", "access", 0), ("lanes", "1", "oneway", 1)],
    node_modifiers=[("highway", "traffic_signals", "fixed", 7), ("ford", "yes", "access", 0)],
)


def _tag(key: str, value, when) -> "F.Column":
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(when, F.struct(F.lit(key).alias("k"), value.alias("v")))


def raw_ways(spark, d) -> DataFrame:
    """Orders as ways with tags by their keys; the order of `junction` and `oneway` differs between them."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("motorway", "motorway_link", "primary", "residential", "construction")])
    found = F.array(
        _tag("junction", "roundabout", (o % 11 == 0) & (o % 2 == 0)),
        _tag("highway", F.element_at(kinds, (c % 5 + 1).cast("int")), o >= 0),
        _tag("oneway", F.when(o % 5 == 0, "yes").when(o % 5 == 1, "-1").otherwise("no"), o % 5 < 3),
        _tag("junction", "roundabout", (o % 11 == 0) & (o % 2 == 1)),
        _tag("maxspeed", F.when(o % 4 == 0, "30 mph").when(o % 4 == 1, "50").otherwise("signals"), o % 4 < 3),
        _tag("access", "private", c % 9 == 1), _tag("vehicle", "maybe", c % 9 == 1), _tag("motor_vehicle", "no", c % 9 == 0),
        _tag("access", "no", c % 9 == 2), _tag("motorcar", "yes", c % 9 == 2),
        _tag("name", F.concat(F.lit(" Street  "), (c % 50).cast("string")), o % 3 != 0), _tag("name:de", F.concat(F.lit("Weg "), (c % 7).cast("string")), o % 10 == 0),
        _tag("ref", F.concat(F.lit("B"), (c % 20).cast("string")), o % 6 == 0),
        _tag("surface", F.when(o % 2 == 0, "gravel").otherwise("paved"), o % 13 < 2), _tag("tunnel", "yes", o % 17 == 0), _tag("toll", "yes", o % 19 == 0), _tag("lanes", "1", o % 23 == 0),
    )
    nodes = F.array(o, o + 1, c)
    return tables.table(spark, d, "orders").select(o.alias("id"), nodes.alias("nodes"), F.filter(found, lambda t: t.isNotNull()).alias("tags"))


_WAYS = """
, o AS (SELECT o_orderkey AS id, o_orderkey AS o, o_custkey AS c, (['motorway','motorway_link','primary','residential','construction'])[o_custkey % 5 + 1] AS kind FROM orders),
d0 AS (SELECT *, o % 11 = 0 AND o % 2 = 0 AS early, o % 11 = 0 AND o % 2 = 1 AS late FROM o),
d1 AS (SELECT *, CASE WHEN early OR kind LIKE 'motorway%' THEN 2 ELSE 0 END AS d FROM d0),
d2 AS (SELECT *, CASE o % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE d END AS e FROM d1),
d3 AS (SELECT *, CASE WHEN late AND e = 0 THEN 2 ELSE e END AS f, early OR (late AND e = 0) AS roundabout FROM d2),
d4 AS (SELECT *, CASE WHEN o % 23 = 0 THEN 2 ELSE f END AS g, coalesce(CASE WHEN o % 10 = 0 THEN 'Weg ' || (c % 7) END, CASE WHEN o % 3 <> 0 THEN 'Street ' || (c % 50) END, '') AS name FROM d3),
decoded AS (SELECT id, CASE WHEN g = 3 THEN [c, o + 1, o] ELSE [o, o + 1, c] END AS nodes, CASE kind WHEN 'motorway' THEN 0 WHEN 'motorway_link' THEN 1 WHEN 'primary' THEN 2 WHEN 'residential' THEN 3 END AS class,
    g IN (2, 3) AS oneway, roundabout, CASE o % 4 WHEN 0 THEN 30 * 1.609344 WHEN 1 THEN 50 END AS max_speed, name, CASE WHEN o % 6 = 0 THEN 'B' || (c % 20) ELSE name END AS ref,
    c % 9 NOT IN (0, 1) AND o % 19 <> 0 AS access, CASE WHEN o % 13 < 2 THEN 2 ELSE 0 END AS fixed, CASE WHEN o % 13 < 2 AND o % 2 = 0 THEN -20 ELSE 0 END AS percent FROM d4)
"""


@query(_WAYS + "SELECT id, array_to_string(nodes, '-') AS nodes, coalesce(class, -1) AS class, oneway, roundabout, round(max_speed::DOUBLE, 6) AS max_speed, name, ref, access, fixed, percent FROM decoded")
def decode_ways(spark, d):
    found = tags.decode_ways(raw_ways(spark, d), PROFILE)
    return found.select("id", F.array_join("nodes", "-").alias("nodes"), F.coalesce("class", F.lit(-1)).alias("class"), "oneway", "roundabout", F.round("max_speed", 6).alias("max_speed"), "name", "ref", "access", "fixed", "percent")


@query(_WAYS + "SELECT class, oneway, count(*) AS n, count(max_speed) AS with_speed, count(DISTINCT name) AS names FROM decoded WHERE class IS NOT NULL AND access GROUP BY 1, 2")
def useful_way_counters(spark, d):
    useful = tags.useful_ways(tags.decode_ways(raw_ways(spark, d), PROFILE))
    return useful.groupBy("class", "oneway").agg(F.count("*").alias("n"), F.count("max_speed").alias("with_speed"), F.countDistinct("name").alias("names"))


def raw_nodes(spark, d) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    barrier = F.when(p % 14 == 0, "toll_booth").otherwise("gate")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("city", "town", "hamlet", "suburb", "village", "island")]), (s % 6 + 1).cast("int"))
    found = F.array(
        _tag("barrier", barrier, (p % 7 == 0) & (p % 2 == 0)), _tag("access", "no", p % 21 == 0), _tag("motorcar", F.when(p % 5 == 0, "yes").otherwise("perhaps"), p % 3 == 0),
        _tag("barrier", barrier, (p % 7 == 0) & (p % 2 == 1)), _tag("place", kind, s % 4 == 0), _tag("name", F.concat(F.lit("Place "), s.cast("string")), s % 4 == 0),
        _tag("population", F.when(p % 2 == 0, (p * 10).cast("string")).otherwise("many"), s % 4 == 0), _tag("highway", "traffic_signals", p % 8 == 0), _tag("ford", "yes", p % 25 == 0),
    )
    return tables.table(spark, d, "part").select(p.alias("id"), F.filter(found, lambda t: t.isNotNull()).alias("tags"))


_NODES = """
, n0 AS (SELECT p_partkey AS id, p_partkey AS p, p_size AS s FROM part),
n1 AS (SELECT *, p % 7 = 0 AND p % 2 = 0 AS early, p % 7 = 0 AND p % 2 = 1 AS late, p % 21 = 0 AS denied, p % 3 = 0 AND p % 5 = 0 AS allowed FROM n0),
n2 AS (SELECT *, CASE WHEN early THEN p % 14 = 0 ELSE true END AS a FROM n1),
n3 AS (SELECT *, CASE WHEN allowed THEN true WHEN denied THEN false ELSE a END AS b FROM n2),
n4 AS (SELECT *, CASE WHEN late AND p % 14 = 0 THEN true WHEN late AND NOT denied AND NOT allowed THEN false ELSE b END AS e FROM n3),
node_tags AS (SELECT id, CASE WHEN p % 25 = 0 THEN false ELSE e END AS access, CASE WHEN p % 8 = 0 THEN 7 ELSE 0 END AS penalty,
    CASE WHEN s % 4 = 0 THEN (['City', 'Town', 'Hamlet', 'Suburb', 'Village', NULL])[s % 6 + 1] END AS place,
    CASE WHEN s % 4 = 0 AND p % 2 = 0 THEN (p * 10)::INT END AS population, CASE WHEN s % 4 = 0 THEN 'Place ' || s ELSE '' END AS name FROM n4)
"""


@query(_NODES + "SELECT * REPLACE (coalesce(population, -1) AS population) FROM node_tags")
def decode_nodes(spark, d):
    return tags.decode_nodes(raw_nodes(spark, d), PROFILE).withColumn("population", F.coalesce("population", F.lit(-1)))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'no' ELSE 'only' END AS kind, o_orderkey AS from_way, o_custkey AS via, o_orderkey + 2 AS to_way
    FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 < 2 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"""
)
def decode_restrictions(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    members = F.array(member("way", o, "from"), F.when(o % 7 != 0, member("node", c, "via")), member("way", o + 1, "to"), member("way", o + 2, "to"), member("way", c, "via"))
    kind = F.when(o % 3 == 0, "no_left_turn").when(o % 3 == 1, "only_straight_on").otherwise("give_way")
    found = F.array(_tag("type", "restriction", o % 4 != 0), _tag("restriction", kind, o >= 0), _tag("except", "bus;motor_vehicle", o % 5 == 0), _tag("except", "bus", o % 5 == 1))
    raw = tables.table(spark, d, "orders").select(o.alias("id"), F.filter(members, lambda m: m.isNotNull()).alias("members"), F.filter(found, lambda t: t.isNotNull()).alias("tags"))
    return tags.decode_restrictions(raw, PROFILE)


_CLASSES = [(0, 0, False, 0.0, 0.0, False, False, False), (1, 1, False, 1.0, 0.5, True, False, False), (2, 2, False, 2.0, 1.0, True, True, False), (3, 3, False, 3.0, 1.5, True, True, True), (4, 4, True, 4.0, 2.0, True, True, True)]
_KIND = "list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], kind) - 1"
_CURVES = """
, k0 AS (SELECT *, lag(next_x - x) OVER w AS lx, lag(next_y - y) OVER w AS ly, lim * average / 100.0 AS raw FROM timed WINDOW w AS (PARTITION BY way, edge ORDER BY pos)),
k1 AS (SELECT *, (atan2(ly, lx) - atan2(-(next_y - y)::DOUBLE, -(next_x - x)::DOUBLE)) / 2.0 AS half FROM k0),
k2 AS (SELECT *, abs(sin(half) / cos(half)) * metres / 2.0 AS radius FROM k1),
curved AS (SELECT *, CASE WHEN radius > 2.5 AND radius < 1000 THEN least(raw, sqrt(1.5 * radius) * 3.6) ELSE raw END AS speed FROM k2)
"""


def _curved(spark, d) -> DataFrame:
    s = tables.segments(spark, d).join(tables.ways(spark, d), "way")
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    s = s.withColumn("metres", F.sqrt(dx * dx + dy * dy) * tables.UNIT_M).withColumn("speed", F.col("limit") * F.col("average") / 100.0)
    return turns.segment_speeds(s, 1.5)


@query(_CURVES + "SELECT way, pos, round(speed, 4) AS speed FROM curved")
def curve_limits(spark, d):
    return _curved(spark, d).select("way", "pos", F.round("speed", 4).alias("speed"))


@query(
    _CURVES
    + f""", cl AS (SELECT * FROM (VALUES {", ".join(str(c) for c in _CLASSES)}) AS v(class, priority, pedestrian, left_penalty, right_penalty, yields_left, yields_right, yields_straight)),
    f AS (SELECT way, edge, {_KIND} AS class, oneway, arg_min(node, pos) AS source, arg_max(next_node, pos) AS target, arg_min(speed, pos) AS s_speed, arg_max(speed, pos) AS t_speed, arg_min(metres, pos) AS s_length,
        arg_max(metres, pos) AS t_length, arg_min(atan2(next_y - y, next_x - x), pos) AS s_angle, arg_max(atan2(y - next_y, x - next_x), pos) AS t_angle FROM curved GROUP BY 1, 2, 3, 4),
    e AS (SELECT source AS node, way, edge, 0 AS side, class, true AS fw, NOT oneway AS bw, s_angle AS angle, s_length AS length, s_speed AS speed FROM f
        UNION ALL SELECT target, way, edge, 1, class, NOT oneway, true, t_angle, t_length, t_speed FROM f),
    h AS (SELECT node, priority, count(*) AS n FROM e JOIN cl USING (class) WHERE bw GROUP BY 1, 2),
    hc AS (SELECT nodes.node, cl.class, coalesce(sum(h.n), 0) AS above FROM nodes, cl LEFT JOIN h ON h.node = nodes.node AND h.priority > cl.priority GROUP BY 1, 2),
    p AS (SELECT a.node, fmod((a.angle - b.angle) / pi() * 180.0 + 360.0, 360.0) - 180.0 AS angle, a.speed AS fs, b.speed AS ts, least(5.0::DOUBLE, a.length, b.length) AS len, ca.class AS fc, cb.class AS tc, b.bw AS tb,
        cb.pedestrian, cb.left_penalty, cb.right_penalty, ca.yields_left, ca.yields_right, ca.yields_straight, hc.above
        FROM e a JOIN e b ON a.node = b.node AND a.bw AND b.fw JOIN cl ca ON ca.class = a.class JOIN cl cb ON cb.class = b.class JOIN hc ON hc.node = a.node AND hc.class = a.class),
    q AS (SELECT *, angle < 0 AND angle > -135 AS l, angle > 0 AND angle < 135 AS r, sin(radians(abs(angle)) / 2) / cos(radians(abs(angle)) / 2) * len / 2.0 AS radius FROM p),
    v1 AS (SELECT *, CASE WHEN radius < 1000 THEN least(least(fs, ts), sqrt(1.5 * radius) * 3.6) ELSE least(fs, ts) END AS v FROM q),
    v2 AS (SELECT *, CASE WHEN pedestrian AND abs(angle) < 135 THEN least(v, 7.0::DOUBLE) ELSE v END AS w FROM v1),
    v3 AS (SELECT *, CASE WHEN (CASE WHEN l THEN yields_left WHEN r THEN yields_right ELSE yields_straight END) AND above - (tc > fc AND tb)::INT >= 1 THEN least(w, 10.0::DOUBLE) ELSE w END AS u FROM v2),
    c AS (SELECT node, l, r, (fs - u) ** 2 / (2.0 * fs * 2.0 * 3.6) + (ts - u) ** 2 / (2.0 * ts * 1.5 * 3.6) + CASE WHEN l THEN left_penalty WHEN r THEN right_penalty ELSE 0 END AS seconds FROM v3)
    SELECT node, count(*) AS turns, round(avg(seconds) FILTER (l), 4) AS "left", round(avg(seconds) FILTER (r), 4) AS "right", round(avg(seconds) FILTER (NOT l AND NOT r), 4) AS straight, round(max(seconds), 4) AS most FROM c GROUP BY 1"""
)
def turn_costs(spark, d):
    """Turn costs at all nodes, as means by side: curves, pedestrians, crossing traffic and slowing down."""
    s = _curved(spark, d)
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    kinds = F.array(*[F.lit(k) for k in ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")])
    s = s.withColumns({"class": (F.array_position(kinds, F.col("kind")) - 1).cast("int"), "dx": dx, "dy": dy, "back_dx": -dx, "back_dy": -dy})
    at = lambda c, which: getattr(F, which)(c, "pos")
    e = s.groupBy("way", "edge").agg(
        F.first("class").alias("class"), F.first("oneway").alias("oneway"), at("node", "min_by").alias("source"), at("next_node", "max_by").alias("target"),
        F.struct(at("dx", "min_by").alias("dx"), at("dy", "min_by").alias("dy"), at("metres", "min_by").alias("length"), at("speed", "min_by").alias("speed")).alias("s"),
        F.struct(at("back_dx", "max_by").alias("dx"), at("back_dy", "max_by").alias("dy"), at("metres", "max_by").alias("length"), at("speed", "max_by").alias("speed")).alias("t"),
    )
    ends = network.edge_ends(e)
    own = lambda c: F.when(F.col("side") == 0, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    ends = ends.select("node", "way", "edge", "side", "forward", "backward", "class", own("dx"), own("dy"), own("length"), own("speed"))
    ends = cut(ends.withColumn("angle", geo.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))).drop("dx", "dy"))
    classes = spark.createDataFrame(_CLASSES, "class int, priority int, pedestrian boolean, left_penalty double, right_penalty double, yields_left boolean, yields_right boolean, yields_straight boolean")
    return turns.turn_averages(turns.turn_costs(ends, classes))


_CITY_RADII = {"City": 3000, "Town": 1500, "Village": 800, "Hamlet": 400}
_CITIES = """
, ring AS (SELECT place, name, k, x + ([-2500,-900,2500,300,2500,-2000])[k] AS rx, y + ([-900,-2500,-2000,100,2500,1800])[k] AS ry FROM places, (SELECT unnest(range(1, 7)) AS k) WHERE place % 2 = 0),
side AS (SELECT a.place, a.rx AS ax, a.ry AS ay, b.rx AS bx, b.ry AS "by" FROM ring a JOIN ring b ON a.place = b.place AND b.k = a.k % 6 + 1),
held AS (SELECT p.place FROM places p JOIN side s USING (place) WHERE ((ay > p.y) <> ("by" > p.y)) AND p.x < (bx - ax) * (p.y - ay) / ("by" - ay)::DOUBLE + ax GROUP BY 1 HAVING count(*) % 2 = 1),
inside AS (SELECT node, max(place) AS place FROM (SELECT n.node, s.place FROM nodes n JOIN side s ON ((ay > n.y) <> ("by" > n.y)) AND n.x < (bx - ax) * (n.y - ay) / ("by" - ay)::DOUBLE + ax
    WHERE s.place IN (SELECT place FROM held) GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1),
near AS (SELECT node, arg_min(place, d2 * 100 + place) AS place FROM (SELECT n.node, p.place, (n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) AS d2,
    CASE kind WHEN 'City' THEN 3000 WHEN 'Town' THEN 1500 WHEN 'Village' THEN 800 WHEN 'Hamlet' THEN 400 END AS r FROM nodes n, places p WHERE p.place NOT IN (SELECT place FROM held)) WHERE d2 < r * r GROUP BY 1),
city AS (SELECT coalesce(i.node, n.node) AS node, coalesce(i.place, n.place) AS place, i.place IS NOT NULL AS inside FROM inside i FULL JOIN near n ON i.node = n.node),
addr AS (SELECT DISTINCT s.way, s.edge, c.place, 'S' || (s.way % 50) AS name FROM (SELECT way, edge, node FROM seg UNION SELECT way, edge, next_node FROM seg) s JOIN city c USING (node) WHERE s.way % 50 <> 7)
"""


def _cities(spark, d) -> DataFrame:
    places = tables.places(spark, d)
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(p(-2500, -900), p(-900, -2500), p(2500, -2000), p(300, 100), p(2500, 2500), p(-2000, 1800))
    outlines = places.where("place % 2 = 0").select(F.col("place").alias("outline"), "name", ring.alias("ring"))
    return cities.in_city(tables.nodes(spark, d), places, outlines, _CITY_RADII)


def _street_names(spark, d) -> DataFrame:
    w = F.col("way")
    return tables.ways(spark, d).select("way", F.when(w % 50 == 7, "").otherwise(F.concat(F.lit("S"), (w % 50).cast("string"))).alias("name"))


def _addresses(spark, d) -> DataFrame:
    segments = cut(tables.segments(spark, d).select("way", "edge", "node", "next_node"))
    return cities.addresses(segments, _street_names(spark, d), cut(_cities(spark, d)))


@query(_CITIES + "SELECT * FROM city")
def in_city(spark, d):
    return _cities(spark, d)


@query(_CITIES + "SELECT * FROM addr")
def addresses(spark, d):
    return _addresses(spark, d).select("way", "edge", "place", "name")


@query(_CITIES + "SELECT name, n_edges, round(metres, 1) AS metres FROM (SELECT place, name, count(*) AS n_edges, sum(metres) AS metres FROM addr JOIN edges USING (way, edge) GROUP BY 1, 2) WHERE place = 4 AND starts_with(lower(name), 's1') ORDER BY metres DESC, name LIMIT 10")
def street_suggest(spark, d):
    """The longest streets of a place that begin with a prefix. Segments are made once; only ways of such a name and nodes of the
    place are joined, and only edges that are found are measured."""
    place, prefix = 4, "S1"
    segments = cut(road._segments(spark, d).select("way", "pos", "edge", "node", "next_node", "metres", "seconds"))
    names = _street_names(spark, d).where(F.startswith(F.lower("name"), F.lit(prefix.lower())))
    named = segments.join(names.select("way"), "way", "left_semi").select("way", "edge", "node", "next_node")
    at = cut(cities.addresses(named, names, cut(_cities(spark, d).where(F.col("place") == place))))
    lengths = network.edges(segments.join(at.select("way", "edge"), ["way", "edge"], "left_semi")).select("way", "edge", "metres")
    found = cities.suggest_streets(cities.streets(at, lengths), place, prefix, 10)
    return found.select("name", "n_edges", F.round("metres", 1).alias("metres"))


_STEPS = """
, t AS (SELECT way AS route, pos, CASE WHEN node % 4 = 0 THEN '' ELSE 'N' || (node % 4) END AS raw, CASE WHEN (way + pos) % 7 < 2 THEN 'roundabout' WHEN (way + pos) % 7 = 2 THEN 'motorway_link' ELSE 'road' END AS type,
    node % 3 > 0 AS branching, node % 50 AS seconds, node % 300 AS distance, node % 7 - 3 AS turn FROM way_nodes),
t1 AS (SELECT *, CASE WHEN type = 'motorway_link' AND max((type <> 'motorway_link')::INT) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1
    THEN coalesce(first(CASE WHEN type <> 'motorway_link' THEN raw END IGNORE NULLS) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), raw) ELSE raw END AS name FROM t),
t2 AS (SELECT *, lag(type) OVER w AS was, lag(branching) OVER w AS split, lag(name) OVER w AS old, row_number() OVER w AS k, coalesce(sum(seconds) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(seconds) OVER (PARTITION BY route) - last(seconds) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole_before FROM t1 WINDOW w AS (PARTITION BY route ORDER BY pos)),
t3 AS (SELECT *, CASE WHEN k = 1 THEN 1 WHEN type = 'roundabout' AND was = 'roundabout' THEN 0 WHEN (type = 'roundabout') <> (was = 'roundabout') THEN 1 ELSE ((split AND abs(turn) > 1) OR old <> name)::INT END AS new,
    CASE WHEN k = 1 OR (was = 'roundabout' AND type <> 'roundabout') THEN 0 ELSE turn END AS direction, (type = 'roundabout' AND was = 'roundabout' AND split)::INT AS exits FROM t2),
t4 AS (SELECT *, sum(new) OVER (PARTITION BY route ORDER BY pos) - 1 AS step FROM t3),
t5 AS (SELECT route, step, arg_min(type, pos) AS type, arg_min(name, pos) AS name, arg_min(direction, pos) AS direction, CASE WHEN arg_min(type, pos) = 'roundabout' THEN 1 + sum(exits) ELSE 0 END AS exit,
    sum(distance) AS m, arg_min(before, pos) AS before, arg_min(whole_before, pos) AS whole_before FROM t4 GROUP BY 1, 2),
t6 AS (SELECT *, max(step) OVER (PARTITION BY route) = step AS final FROM t5),
t7 AS (SELECT *, CASE WHEN m < 100 THEN m || 'm' WHEN m < 1000 THEN (m - m % 10) || 'm' ELSE (m // 1000) || '.' || ((m // 100) % 10) || 'km' END AS far,
    CASE direction WHEN 1 THEN 'Keep slightly right' WHEN 2 THEN 'Turn right' WHEN 3 THEN 'Turn sharply right' WHEN -1 THEN 'Keep slightly left' WHEN -2 THEN 'Turn left' WHEN -3 THEN 'Turn sharply left' END AS words FROM t6 WHERE before < 100 AND (NOT final OR whole_before < 100))
SELECT route, step::BIGINT AS step, CASE WHEN exit > 0 THEN 'Enter the roundabout. Take the ' || exit::INT || '. exit.' ELSE concat_ws(' ', CASE WHEN type = 'motorway_link' THEN CASE WHEN name <> '' THEN 'Take the ramp towards ' || name || '.' ELSE 'Take the ramp.' END
    WHEN direction <> 0 THEN words || CASE WHEN name <> '' THEN ' into ' || name ELSE '' END || '.' END, CASE WHEN m > 20 THEN CASE WHEN name <> '' THEN 'Continue on ' || name || ' for ' ELSE 'Continue for ' END || far || '.' END) END AS text FROM t7
"""


@query(_STEPS)
def route_instructions(spark, d):
    """Sentences for each step of a route within a horizon of 100 seconds."""
    n, w = F.col("node"), F.col("way") + F.col("pos")
    kind = F.when(w % 7 < 2, "roundabout").when(w % 7 == 2, "motorway_link").otherwise("road")
    name = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("N"), (n % 4).cast("string")))
    route = tables.way_nodes(spark, d).select(
        F.col("way").alias("route"), "pos", name.alias("name"), kind.alias("type"), (n % 3 > 0).alias("branching"), (n % 50).alias("seconds"), (n % 300).alias("distance"), (n % 7 - 3).alias("turn")
    )
    found = instructions.labels(instructions.within(instructions.steps(route), 100))
    return found.select("route", "step", F.array_join("labels", " ").alias("text"))


@query(
    """, z AS (SELECT unnest(range(3, 8)) AS zoom), b AS (SELECT place AS box, greatest(x - 2000, 0) AS min_x, greatest(y - 2000, 0) AS min_y, least(x + 2000, 32767) AS max_x, least(y + 2000, 32767) AS max_y FROM places),
    r AS (SELECT box, zoom, greatest((min_x >> (15 - zoom)::INT) - 1, 0) AS x0, least((max_x >> (15 - zoom)::INT) + 1, (1 << zoom) - 1) AS x1, greatest((min_y >> (15 - zoom)::INT) - 1, 0) AS y0, least((max_y >> (15 - zoom)::INT) + 1, (1 << zoom) - 1) AS y1 FROM b, z),
    c AS (SELECT box, zoom::INT AS zoom, tile_x, unnest(range(y0, y1 + 1)) AS tile_y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS tile_x FROM r))
    SELECT *, (((tile_y << 24) | tile_x) << 5) | zoom AS id FROM c"""
)
def tile_cover(spark, d):
    x, y = F.col("x"), F.col("y")
    boxes = tables.places(spark, d).select(F.col("place").alias("box"), F.greatest(x - 2000, F.lit(0)).alias("min_x"), F.greatest(y - 2000, F.lit(0)).alias("min_y"), F.least(x + 2000, F.lit(32767)).alias("max_x"), F.least(y + 2000, F.lit(32767)).alias("max_y"))
    return tiles.cover(boxes, 15, range(3, 8)).withColumn("id", tiles.tile_id(F.col("tile_x"), F.col("tile_y"), F.col("zoom")))


@query(
    """, z AS (SELECT unnest(range(3, 9)) AS zoom), t AS (SELECT DISTINCT zoom::INT AS zoom, x >> (15 - zoom)::INT AS tx, y >> (15 - zoom)::INT AS ty FROM nodes, z),
    l AS (SELECT zoom, min(tx) AS lx, min(ty) AS ly FROM t GROUP BY 1) SELECT zoom, (tx - lx) // 4 AS meta_x, (ty - ly) // 4 AS meta_y, count(*) AS n FROM t JOIN l USING (zoom) GROUP BY 1, 2, 3"""
)
def metatiles(spark, d):
    return tiles.metatiles(tiles.occupied(tables.nodes(spark, d), 15, range(3, 9)), 4)


_RULES = [("oneway", "-1", 9), ("highway", "motorway", 1), ("tunnel", "*", 8), ("junction", "roundabout", 7), ("highway", "primary", 3), ("highway", "*", 4)]
_DRAW = [(1, 1, 3, 12, 0), (1, 4, 10, 14, 1), (7, 8, 12, 17, 0), (4, 9, 13, 17, 2)]


@query(
    f""", y AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 9 WHEN o_custkey % 5 = 0 THEN 1 WHEN o_orderkey % 17 = 0 THEN 8 WHEN o_orderkey % 11 = 0 THEN 7 WHEN o_custkey % 5 = 2 THEN 3 ELSE 4 END AS type FROM orders),
    r AS (SELECT * FROM (VALUES {", ".join(str((i, *r)) for i, r in enumerate(_DRAW))}) AS v(rule, low, high, from_zoom, to_zoom, pass)), z AS (SELECT unnest(range(2, 19))::INT AS zoom)
    SELECT id, zoom, min(rule) AS rule, arg_min(pass, rule) AS pass FROM y, z JOIN r ON type BETWEEN low AND high AND zoom BETWEEN from_zoom AND to_zoom GROUP BY 1, 2"""
)
def drawing_rules(spark, d):
    """Types by tags, the first rule that a way meets, and the drawing rule of each at each zoom."""
    flat = raw_ways(spark, d).select("id", F.explode("tags").alias("t")).select("id", "t.k", "t.v")
    return tiles.drawn(tiles.first_rule(flat, _RULES), _DRAW, range(2, 19))


_Q = f"(({road._interleave('x')}) * 2) + ({road._interleave('y')})"


@query(
    f""", q AS (SELECT ({_Q}) >> 16 AS leaf FROM nodes), c AS (SELECT lv::INT AS level, leaf >> (2 * (8 - lv))::INT AS prefix, count(*) AS n FROM q, (SELECT unnest(range(0, 9)) AS lv) GROUP BY 1, 2)
    SELECT c.* FROM c LEFT JOIN c AS u ON u.level = c.level - 1 AND u.prefix = c.prefix >> 2 WHERE c.level = 0 OR u.n >= 5"""
)
def quadtree_counts(spark, d):
    quads = tables.nodes(spark, d).select(geo.quadtile(F.col("x"), F.col("y")).alias("quadtile"))
    return tiles.quadtree(quads, 16, 8, 5)


@query(
    f""", q AS (SELECT place, name, kind, {_Q} AS quadtile FROM places), z AS (SELECT unnest(range(5, 14))::INT AS zoom)
    SELECT place, zoom FROM q, z WHERE list_position(['City','Town','Village','Station','Suburb','Hamlet'], kind) > 0 AND zoom >= list_position(['City','Town','Village','Station','Suburb','Hamlet'], kind) + 5 AND (quadtile >> 28) = 1"""
)
def tile_labels(spark, d):
    """Labels of one tile by a range of quadtiles, at the zooms that show them."""
    rows = tables.places(spark, d).withColumn("quadtile", geo.quadtile(F.col("x"), F.col("y")))
    levels = tiles.by_quadtile(rows, 1, 15, 1).withColumn("zoom", F.explode(F.sequence(F.lit(5), F.lit(13))))
    return levels.where(tiles.label_visible(F.col("kind"), F.col("zoom"))).select("place", "zoom")


@query(
    """, b AS (SELECT place AS package, x - 6000 AS min_x, y - 6000 AS min_y, x + 6000 AS max_x, y + 6000 AS max_y FROM places)
    SELECT point, package, (row_number() OVER (PARTITION BY point ORDER BY package) - 1)::INT AS hit FROM points JOIN b ON px BETWEEN min_x AND max_x AND py BETWEEN min_y AND max_y"""
)
def package_hits(spark, d):
    x, y = F.col("x"), F.col("y")
    packages = tables.places(spark, d).select(F.col("place").alias("package"), (x - 6000).alias("min_x"), (y - 6000).alias("min_y"), (x + 6000).alias("max_x"), (y + 6000).alias("max_y"))
    return tiles.in_packages(tables.points(spark, d), packages)


@query(
    """, l AS (SELECT way, list(node ORDER BY pos) AS nodes FROM way_nodes GROUP BY 1), z AS (SELECT unnest([8, 12]) AS zoom)
    SELECT way, zoom::INT AS zoom, len(CASE WHEN zoom < 10 AND len(nodes) > 2 THEN [nodes[1], nodes[-1]] ELSE nodes END)::INT AS n FROM l JOIN ways USING (way), z WHERE zoom > 11 OR kind = '1-URGENT'"""
)
def levels_of_detail(spark, d):
    """Ways at a low zoom, motorways alone with their ends, and at a high one, all with all their nodes."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda p: p["node"])
    rows = tables.way_nodes(spark, d).groupBy("way").agg(line.alias("nodes")).join(tables.ways(spark, d).select("way", "kind"), "way")
    rows = rows.withColumn("zoom", F.explode(F.array(F.lit(8), F.lit(12)))).where((F.col("zoom") > 11) | (F.col("kind") == "1-URGENT"))
    return rows.select("way", "zoom", F.size(tiles.simplified(F.col("nodes"), F.col("zoom"))).alias("n"))


@query(
    """, g AS (SELECT node, x, y, x / 32768.0::DOUBLE * 360.0 - 180.0 AS lon, y / 32768.0::DOUBLE * 160.0 - 80.0 AS lat, node % 360 AS h FROM nodes)
    SELECT node, round(degrees(atan(0.5 * (exp(pi() - 2 * pi() * (y / 32768.0::DOUBLE)) - exp(-(pi() - 2 * pi() * (y / 32768.0::DOUBLE)))))), 8) AS unprojected,
    floor(x / 32768.0::DOUBLE * 1073741824)::BIGINT AS quantised, floor(x / 32768.0::DOUBLE * 1073741824)::BIGINT >> 20 AS tile10, (floor(x / 32768.0::DOUBLE * 1073741824)::BIGINT & 1048575) >> 12 AS sub8,
    round(atan2(y - 16384, x - 16384), 9) AS bearing, round(fmod((h - 170) + 360.0::DOUBLE, 360.0) - 180.0, 6) AS angle,
    (greatest(10000 - x, 0, x - 20000)) ** 2 + (greatest(10000 - y, 0, y - 20000)) ** 2 AS box2,
    round(1073741824 / 360.0::DOUBLE / (2.0 * 6372797.560856 * asin(sqrt(cos(radians(lat)) ** 2 * sin(radians(1.0) / 2) ** 2))), 6) AS per_metre,
    round(fmod((h + 270.0) * (2 * pi() / 360), 2 * pi()), 9) AS heading, (node // 3600) || ':' || lpad((node % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((node % 60)::VARCHAR, 2, '0') AS clock, x AS qx, y AS qy FROM g"""
)
def scalar_functions(spark, d):
    """Unprojection, quantising, tiles within tiles, bearings, angles, box distances, units, headings, clock and quadtiles."""
    from wayfold.operators.spatial import heading_radians

    x, y, h = F.col("x"), F.col("y"), F.col("node") % 360
    q = geo.quantise(x / 32768.0)
    qx, qy = geo.quadtile_xy(geo.quadtile(x, y))
    lat = y / 32768.0 * 160.0 - 80.0
    return tables.nodes(spark, d).select(
        "node", F.round(geo.latitude(y / 32768.0), 8).alias("unprojected"), q.alias("quantised"), geo.tile(q, 10).alias("tile10"), geo.sub_tile(q, 10, 8).alias("sub8"),
        F.round(geo.bearing(x - 16384, y - 16384), 9).alias("bearing"), F.round((h - 170 + 360.0) % 360.0 - 180.0, 6).alias("angle"),
        geo.box_distance2(x, y, F.lit(10000), F.lit(10000), F.lit(20000), F.lit(20000)).cast("double").alias("box2"), F.round(geo.units_per_metre(lat), 6).alias("per_metre"),
        F.round(heading_radians(h), 9).alias("heading"), instructions.hours_minutes_seconds(F.col("node")).alias("clock"), qx.alias("qx"), qy.alias("qy"),
    )


@query(
    """, e AS (SELECT source, target, way, edge, oneway, row_number() OVER (PARTITION BY source, target ORDER BY way, edge) - 1 AS ordinal FROM edges),
    g AS (SELECT node, sum(forward::INT) AS deg FROM ends GROUP BY 1)
    SELECT source, target, way, edge, ordinal::INT AS ordinal, deg - (NOT oneway)::INT > 1 AS branching FROM e JOIN g ON g.node = e.target"""
)
def edge_keys(spark, d):
    """Edges by (source, target, ordinal), the number among parallel ones, and whether another way leaves at their end."""
    return network.edge_keys(road._edges(spark, d).select("way", "edge", "source", "target", "oneway"), tables.shares(spark, d))


@query("SELECT node, true AS close FROM nodes WHERE x BETWEEN 6000 AND 30000")
def vincenty_check(spark, d):
    """Whether distances on the ellipsoid are within 0.6 per cent of those on the sphere, for nodes away from the far side."""
    lon, lat = F.col("x") / 32768.0 * 360.0 - 180.0, F.col("y") / 32768.0 * 160.0 - 80.0
    far = geo.vincenty_m(F.lit(10.0), F.lit(20.0), lat, lon), geo.haversine_m(F.lit(10.0), F.lit(20.0), lat, lon)
    return tables.nodes(spark, d).where("x between 6000 and 30000").select("node", (F.abs(far[0] - far[1]) <= 0.006 * far[1] + 1).alias("close"))
