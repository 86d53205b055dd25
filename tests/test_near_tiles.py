"""Nearest targets without a radius, and lines and areas cut by tiles, against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import nearest, tiles

POINTS, TARGETS = "point long, px long, py long, x long", "id long, x long, y long, n long"


def tables(seed, bits):
    """Clusters, a third of all targets at one place and a third of all points at another, corners, and far empty parts."""
    rng, top = np.random.default_rng(seed), (1 << bits) - 1
    near = lambda n, c, s: np.clip(rng.normal(c, s, size=(n, 2)), 0, top).astype(int).tolist()
    spots = near(150, top * 0.3, top * 0.01) + near(60, top * 0.8, top * 0.2) + [[top // 5, top // 7]] * 120 + [[0, 0], [top, top]]
    asked = near(80, top * 0.31, top * 0.02) + near(40, top * 0.5, top * 0.5) + [[top // 5 + 3, top // 7]] * 70 + [[top, 0], [0, top], [top // 5, top // 7]]
    points = [(i, *p, 0) for i, p in enumerate(asked)] + [(900, None, 4, 0), (901, 4, None, 0)]
    return points, [(1000 - i, *p, 0) for i, p in enumerate(spots)] + [(2000, None, 3, 0)]


@pytest.mark.parametrize("k,bits,seed", [(1, 15, 0), (5, 15, 1), (5, 30, 2), (400, 12, 3)])
def test_nearest_by_brute_force(spark, k, bits, seed):
    points, targets = tables(seed, bits)
    found = nearest.k_nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS), k, bits)
    wanted = []
    for p, px, py, _ in points:
        if px is not None and py is not None:
            near = sorted(((x - px) ** 2 + (y - py) ** 2, i) for i, x, y, _ in targets if x is not None)[:k]
            wanted += [(p, r + 1, i, d2) for r, (d2, i) in enumerate(near)]
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_no_targets_or_points(spark):
    points, targets = tables(0, 15)
    some, none = spark.createDataFrame(points, POINTS), spark.createDataFrame([], TARGETS)
    assert nearest.k_nearest(some, none, 3, 15).count() == 0
    assert nearest.k_nearest(some.limit(0), spark.createDataFrame(targets, TARGETS), 3, 15).count() == 0


def test_cells_hold_few_targets(spark):
    """A leaf has at most k targets, even at the place where a third of all are, and every target is in one."""
    _, targets = tables(4, 15)
    cells = nearest.index(spark.createDataFrame(targets, TARGETS), 4, 15)
    assert cells.targets.groupBy("leaf", "leaf_prefix").count().agg(F.max("count")).first()[0] <= 4
    places = collections.Counter(t[1:3] for t in targets if t[1] is not None)
    assert cells.targets.count() == sum(min(4, n) for n in places.values())


@pytest.mark.parametrize("bits,zoom", [(15, 3), (30, 9), (30, 0)])
def test_pieces_rejoin_to_the_line(spark, bits, zoom):
    rng, size = np.random.default_rng(bits + zoom), 1 << (bits - zoom)
    spread = min(6 * size, (1 << bits) - 1)
    rows, lines = [], {}
    for way in range(30):
        line = rng.integers(0, spread, size=(6, 2)).tolist()
        if way % 3 == 0:  # points and stretches on borders, and repeated points
            line = [[x // size * size, y if way % 2 else y // size * size] for x, y in line]
            line[3] = line[2]
        lines[way] = line
        rows += [(way, i, *line[i], *line[i + 1]) for i in range(5)]
    found = tiles.cut_lines(spark.createDataFrame(rows, "way long, pos long, x long, y long, next_x long, next_y long"), bits, zoom).collect()
    ways = collections.defaultdict(list)
    for r in found:
        ways[r.way].append(r)
        for p in r.line:
            assert r.tile_x * size - 1e-3 <= p.x <= (r.tile_x + 1) * size + 1e-3 and r.tile_y * size - 1e-3 <= p.y <= (r.tile_y + 1) * size + 1e-3
    for way, line in lines.items():
        own = sorted(ways[way], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(a.line[-1] == b.line[0] and (a.tile_x, a.tile_y) != (b.tile_x, b.tile_y) for a, b in zip(own, own[1:]))
        walked = [(p.x, p.y) for r in own for p in r.line]
        at = 0
        for x, y in line:  # the line's own points come in their order
            at = walked.index((float(x), float(y)), at)
    assert tiles.cut_lines(spark.createDataFrame([], "way long, pos long, x long, y long, next_x long, next_y long"), bits, zoom).count() == 0


def test_areas_of_too_many_tiles_are_left_out(spark):
    ring = lambda *p: [{"x": x, "y": y} for x, y in p]
    rows = [(1, ring((0, 0), (640, 10), (64, 130))), (2, ring((0, 0), (1 << 29, 1 << 29), (5, 5))), (3, []), (4, None)]
    found = tiles.area_tiles(spark.createDataFrame(rows, "ring_id long, ring array<struct<x: long, y: long>>"), 30, 24).collect()
    assert sorted((r.ring_id, r.tile_x, r.tile_y) for r in found) == [(1, x, y) for x in range(11) for y in range(3)]


def test_quadtiles_of_thirty_bits(spark):
    rows = [(0, 0), (1, 0), (0, 1), ((1 << 30) - 1, 12345), (987654321, (1 << 30) - 1), ((1 << 31) - 1, 5)]
    x, y = geo.quadtile_xy(F.col("q"))
    found = spark.createDataFrame(rows, "x long, y long").withColumn("q", geo.quadtile(F.col("x"), F.col("y"))).select("q", x.alias("x"), y.alias("y")).collect()
    assert [(r.x, r.y) for r in found] == rows
    assert [r.q for r in found] == [sum((x >> i & 1) << 2 * i + 1 | (y >> i & 1) << 2 * i for i in range(31)) for x, y in rows]


def test_a_line_that_starts_on_a_border_has_no_empty_piece(spark):
    rows = [(1, 0, 16, 16, 10, 10), (2, 0, 16, 16, 20, 20), (3, 0, 16, 5, 3, 5), (4, 0, 16, 16, 3, 40)]
    segments = spark.createDataFrame(rows, "way long, pos long, x long, y long, next_x long, next_y long")
    parts = tiles.cut_segments(segments, 6, 2).collect()
    assert all((r.from_x, r.from_y) != (r.to_x, r.to_y) for r in parts)
    assert sorted((r.way, r.tile_x, r.tile_y) for r in parts) == [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (4, 0, 2)]


def test_packages_of_all_sizes_by_brute_force(spark):
    """Packages from a point to the whole plane, a busy cell, nulls, and packages turned round."""
    draw = random.Random(5)
    points = [(k, draw.randrange(-3000, 3000), draw.randrange(-3000, 3000)) for k in range(300)] + [(k, 7, 7) for k in range(300, 500)] + [(500, None, 3)]
    packages = [(k, *(draw.randrange(-3000, 3000) for _ in range(2))) for k in range(60)]
    packages = [(k, x, y, x + draw.choice([0, 3, 90, 2000]), y + draw.choice([0, 5, 700])) for k, x, y in packages]
    packages += [(60, -4000, -4000, 4000, 4000), (61, 7, 7, 7, 7), (62, None, 0, 9, 9), (63, 9, 9, 0, 0)]
    own = spark.createDataFrame(points, "point long, px long, py long")
    boxes = spark.createDataFrame(packages, "package long, min_x long, min_y long, max_x long, max_y long")
    want = set()
    for p, x, y in points:
        over = [k for k, a, b, c, d in packages if None not in (x, y, a, b, c, d) and a <= x <= c and b <= y <= d]
        want |= {(p, k, i) for i, k in enumerate(sorted(over))}
    found = tiles.in_packages(own, boxes)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 700
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tiles.in_packages(own, boxes.where("false")).count() == 0 and tiles.in_packages(own.where("false"), boxes).count() == 0
