"""Queries on the nearest targets without a radius, and on lines and areas cut by tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import nearest, tiles
from wayfold.plans import road, tables
from wayfold.plans.road import query


def _nearest_sql(k: int, table: str, ident: str) -> str:
    return f"""SELECT point, row_number() OVER w AS rank, {ident}, d2 FROM (SELECT point, {ident}, (px - x) * (px - x) + (py - y) * (py - y) AS d2 FROM points, {table})
    WINDOW w AS (PARTITION BY point ORDER BY d2, {ident}) QUALIFY rank <= {k}"""


@query(_nearest_sql(1, "nodes", "node"))
def nearest_node(spark, d):
    return nearest.k_nearest(tables.points(spark, d), tables.nodes(spark, d), 1, 15, ident="node")


@query(_nearest_sql(5, "nodes", "node"))
def five_nearest_nodes(spark, d):
    return nearest.k_nearest(tables.points(spark, d), tables.nodes(spark, d), 5, 15, ident="node")


def pieces_sql(size: int) -> str:
    """The ways cut at the borders of tiles of a size, as p (way, piece, pos, sub, tile_x, tile_y, ..)."""
    return """, b AS (SELECT way, pos, x, y, next_x - x AS dx, next_y - y AS dy, next_x, next_y FROM seg),
    c AS (SELECT way, pos, x, y, dx, dy, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat(
        list_transform(range(least(x // {size}, next_x // {size}) + 1, greatest(x // {size}, next_x // {size}) + 1), lambda i: (i * {size}.0::DOUBLE - x) / dx::DOUBLE),
        list_transform(range(least(y // {size}, next_y // {size}) + 1, greatest(y // {size}, next_y // {size}) + 1), lambda i: (i * {size}.0::DOUBLE - y) / dy::DOUBLE))))) AS t FROM b),
    u AS (SELECT *, unnest(range(1, len(t))) AS sub FROM c),
    s AS (SELECT way, pos, sub, floor((x + (t[sub] + t[sub + 1]) / 2.0 * dx) / {size}.0)::BIGINT AS tile_x, floor((y + (t[sub] + t[sub + 1]) / 2.0 * dy) / {size}.0)::BIGINT AS tile_y,
        x + t[sub] * dx AS from_x, y + t[sub] * dy AS from_y, x + t[sub + 1] * dx AS to_x, y + t[sub + 1] * dy AS to_y FROM u),
    n AS (SELECT *, CASE WHEN tile_x = lag(tile_x) OVER w AND tile_y = lag(tile_y) OVER w AND from_x = lag(to_x) OVER w AND from_y = lag(to_y) OVER w THEN 0 ELSE 1 END AS new
        FROM s WINDOW w AS (PARTITION BY way ORDER BY pos, sub)),
    p AS (SELECT *, (sum(new) OVER (PARTITION BY way ORDER BY pos, sub))::BIGINT - 1 AS piece FROM n)""".replace("{size}", str(size))


@query(
    pieces_sql(8192)
    + """
    SELECT way, piece, min(tile_x) AS tile_x, min(tile_y) AS tile_y, count(*) + 1 AS n_points, round(arg_min(from_x, pos * 1000 + sub), 4) AS first_x, round(arg_min(from_y, pos * 1000 + sub), 4) AS first_y,
        round(arg_max(to_x, pos * 1000 + sub), 4) AS last_x, round(arg_max(to_y, pos * 1000 + sub), 4) AS last_y FROM p GROUP BY 1, 2"""
)
def tile_lines(spark, d):
    """All ways cut at the borders of 16 tiles."""
    segments = tables.segments(spark, d)
    cut = tiles.cut_lines(segments, 15, 2)
    at = lambda i, v: F.round(F.element_at("line", i)[v], 4)
    return cut.select(
        "way", "piece", "tile_x", "tile_y", F.size("line").cast("long").alias("n_points"), at(1, "x").alias("first_x"), at(1, "y").alias("first_y"), at(-1, "x").alias("last_x"), at(-1, "y").alias("last_y")
    )


@query(
    """, box AS (SELECT place, (x - 2500) >> 6 AS lx, (x + 2500) >> 6 AS hx, (y - 2500) >> 6 AS ly, (y + 2500) >> 6 AS hy FROM places)
    SELECT place AS ring_id, tile_x, unnest(range(ly, hy + 1)) AS tile_y FROM (SELECT *, unnest(range(lx, hx + 1)) AS tile_x FROM box WHERE (hx - lx + 1) * (hy - ly + 1) <= 6300)"""
)
def area_tiles(spark, d):
    """Tiles of the places' outlines; those that cover over 6300 tiles are left out."""
    return tiles.area_tiles(road._rings(spark, d), 15, 9, 6300)
