"""Map tiles as rows: covers, occupancy, drawing rules, labels, levels of detail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.operators import spatial

# Place types in the order of label sizes, and the zoom from which each is shown.
LABEL_ORDER = ["City", "Town", "Village", "Station", "Suburb", "Hamlet"]


def tile_id(x: Column, y: Column, zoom: Column) -> Column:
    """One number for a tile: y, then x, then the zoom in five bits."""
    return F.shiftleft(F.shiftleft(y.cast("long"), 24).bitwiseOR(x.cast("long")), 5).bitwiseOR(zoom.cast("long"))


def cover(boxes: DataFrame, bits: int, zooms: range, margin: int = 1) -> DataFrame:
    """box, zoom, tile_x, tile_y of all tiles over boxes (box, min_x, min_y, max_x, max_y) in coordinates of `bits` bits, and
    `margin` tiles around them."""
    levels = boxes.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    down = lambda c: F.expr(f"shiftright({c}, {bits} - zoom)")
    last = F.expr("shiftleft(1L, zoom) - 1")
    span = lambda v: F.sequence(F.greatest(down(f"min_{v}") - margin, F.lit(0)).cast("long"), F.least(down(f"max_{v}") + margin, last).cast("long"))
    return levels.withColumn("tile_x", F.explode(span("x"))).select("box", "zoom", "tile_x", F.explode(span("y")).alias("tile_y"))


def occupied(points: DataFrame, bits: int, zooms: range) -> DataFrame:
    """zoom, tile_x, tile_y of the tiles that hold some of the points (x, y), from the distinct ones of the finest zoom."""
    top = max(zooms)
    finest = points.select(F.shiftright("x", bits - top).alias("fx"), F.shiftright("y", bits - top).alias("fy")).distinct()
    levels = finest.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    return levels.select("zoom", F.expr(f"shiftright(fx, {top} - zoom)").alias("tile_x"), F.expr(f"shiftright(fy, {top} - zoom)").alias("tile_y")).distinct()


def metatiles(tiles: DataFrame, side: int) -> DataFrame:
    """tiles (zoom, tile_x, tile_y) counted by blocks of side x side, from the least tile of each zoom on."""
    low = tiles.groupBy("zoom").agg(F.min("tile_x").alias("low_x"), F.min("tile_y").alias("low_y"))
    block = lambda v: F.floor((F.col(f"tile_{v}") - F.col(f"low_{v}")) / side).alias(f"meta_{v}")
    return tiles.join(low, "zoom").groupBy("zoom", block("x"), block("y")).agg(F.count("*").alias("n"))


def first_rule(tags: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """id, type of ways by their tags (id, k, v): of the rules (key, value or *, type) that a tag meets the first counts."""
    table = tags.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, rule_key string, rule_value string, type int")
    hits = tags.join(F.broadcast(table), (F.col("k") == F.col("rule_key")) & ((F.col("rule_value") == "*") | (F.col("v") == F.col("rule_value"))))  # the rules given
    return hits.groupBy("id").agg(F.min_by("type", "rule").alias("type"))


def drawn(ways: DataFrame, rules: list[tuple[int, int, int, int, int]], zooms: range) -> DataFrame:
    """id, zoom, rule of ways (id, type) at each zoom: the first of the rules (low type, high type, low zoom, high zoom, pass)
    that holds, by its place; ways without a rule aren't drawn."""
    table = ways.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, low int, high int, from_zoom int, to_zoom int, pass int")
    levels = ways.select("id", "type", F.explode(F.array(*[F.lit(z) for z in zooms])).alias("zoom"))
    on = F.col("type").between(F.col("low"), F.col("high")) & F.col("zoom").between(F.col("from_zoom"), F.col("to_zoom"))
    hits = levels.join(F.broadcast(table), on)  # the rules given
    return hits.groupBy("id", "zoom").agg(F.min("rule").alias("rule"), F.min_by("pass", "rule").alias("pass"))


def label_visible(kind: Column, zoom: Column) -> Column:
    """Places by type: the larger their label's rank the later they show, one rank a zoom from 6 on."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LABEL_ORDER]), kind)
    return (rank > 0) & (zoom >= rank + 5)


def simplified(line: Column, zoom: Column) -> Column:
    """A line's points at a zoom: below 10 its ends alone."""
    return F.when((zoom < 10) & (F.size(line) > 2), F.array(F.get(line, 0), F.element_at(line, -1))).otherwise(line)


def area_tiles(rings: DataFrame, bits: int, zoom: int, most: int = 10_000) -> DataFrame:
    """ring_id, tile_x, tile_y of the tiles over the bounding box of each ring (an array of x, y); an area that covers more
    than `most` tiles, or has no points, has none."""
    low = lambda v: F.shiftright(F.array_min(F.transform("ring", lambda p: p[v])), bits - zoom).cast("long").alias(f"low_{v}")
    high = lambda v: F.shiftright(F.array_max(F.transform("ring", lambda p: p[v])), bits - zoom).cast("long").alias(f"high_{v}")
    boxes = rings.select("ring_id", low("x"), low("y"), high("x"), high("y"))
    small = boxes.where("(high_x - low_x + 1) * (high_y - low_y + 1) <= %d" % most)
    wide = small.select("ring_id", F.explode(F.sequence("low_x", "high_x")).alias("tile_x"), "low_y", "high_y")
    return wide.select("ring_id", "tile_x", F.explode(F.sequence("low_y", "high_y")).alias("tile_y"))


def cut_segments(segments: DataFrame, bits: int, zoom: int) -> DataFrame:
    """segments (way, pos, x, y, next_x, next_y in coordinates of `bits` bits) cut where they cross tile borders: way, pos,
    sub, tile_x, tile_y, from_x, from_y, to_x, to_y (doubles), in the order along the segment.

    Crossings are places t between 0 and 1 along the segment, those with columns and with rows of tiles merged. A part belongs to
    the tile of its middle, so one along a border to the tile right of it or below. A segment of no length is one part.
    """
    size, (dx, dy) = float(1 << (bits - zoom)), (F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))

    def crossings(v: str, d: Column) -> Column:
        tile = lambda c: F.floor(F.col(c) / size)
        first, last = F.least(tile(v), tile(f"next_{v}")) + 1, F.greatest(tile(v), tile(f"next_{v}"))
        borders = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        # A crossing at the start is -0.0 where the segment goes back from it, which would stand beside 0.0.
        return F.transform(borders, lambda b: (b * size - F.col(v)) / d.cast("double") + F.lit(0.0))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    t = F.array_sort(F.array_distinct(F.concat(ends, crossings("x", dx), crossings("y", dy))))
    parts = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(i.alias("sub"), F.get("t", i - 1).alias("t0"), F.get("t", i).alias("t1")))
    rows = segments.withColumn("t", t).select("way", "pos", "x", "y", dx.alias("dx"), dy.alias("dy"), F.explode(parts).alias("p")).select("*", "p.*")
    at = lambda v, t: F.col(v) + F.col(t) * F.col(f"d{v}")
    tile = lambda v: F.floor((F.col(v) + (F.col("t0") + F.col("t1")) / 2.0 * F.col(f"d{v}")) / size).alias(f"tile_{v}")
    return rows.select(
        "way", "pos", "sub", tile("x"), tile("y"), at("x", "t0").alias("from_x"), at("y", "t0").alias("from_y"), at("x", "t1").alias("to_x"), at("y", "t1").alias("to_y")
    )


def cut_lines(segments: DataFrame, bits: int, zoom: int) -> DataFrame:
    """way, piece, tile_x, tile_y, line of the ways cut at tile borders: a piece is what a way has in a tile until it leaves
    it, numbered along the way from 0; its line (an array of x, y) begins where that of the piece before ends.

    A gap between segments begins a new piece too. Pieces of a way are numbered in one task, its length in nodes.
    """
    along = W.partitionBy("way").orderBy("pos", "sub")
    before = lambda c: F.lag(c).over(along)
    same = (before("tile_x") == F.col("tile_x")) & (before("tile_y") == F.col("tile_y")) & (before("to_x") == F.col("from_x")) & (before("to_y") == F.col("from_y"))
    parts = cut_segments(segments, bits, zoom).withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int"))
    parts = parts.withColumn("piece", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)) - 1)
    point = lambda p: F.struct(F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"))
    pieces = parts.groupBy("way", "piece").agg(
        F.first("tile_x").alias("tile_x"), F.first("tile_y").alias("tile_y"), F.min_by(point("from"), F.struct("pos", "sub")).alias("start"),
        F.sort_array(F.collect_list(F.struct("pos", "sub", point("to").alias("to")))).alias("rest"),
    )
    return pieces.select("way", "piece", "tile_x", "tile_y", F.concat(F.array("start"), F.col("rest.to")).alias("line"))


def held(segments: DataFrame, bits: int, zoom: int) -> DataFrame:
    """tile_x, tile_y, n_pieces, n_ways, n_points: what each tile holds of the pieces that cut_lines gives. Ways are cut and
    counted where they lie together, so only a row a tile and batch leaves a task, and no piece is written."""
    size = float(1 << (bits - zoom))
    names = ["tile_x", "tile_y", "n_pieces", "n_ways", "n_points"]

    def counts(rows: pa.Table) -> pa.RecordBatch:
        way, x, y, next_x, next_y = (rows.column(c).to_numpy() for c in ("way", "x", "y", "next_x", "next_y"))
        n = np.arange(len(way))
        dx, dy = (next_x - x).astype(float), (next_y - y).astype(float)
        which, t = [n, n], [np.zeros(len(n)), np.ones(len(n))]
        for v, end, d in ((x, next_x, dx), (y, next_y, dy)):
            a, b = np.floor(v / size).astype(np.int64), np.floor(end / size).astype(np.int64)
            many = np.abs(a - b)
            own = np.repeat(n, many)
            border = np.minimum(a, b)[own] + 1 + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            which.append(own)
            t.append((border * size - v[own]) / d[own])
        which, t = np.concatenate(which), np.concatenate(t)
        order = np.lexsort((t, which))
        which, t = which[order], t[order]
        part = np.flatnonzero((which[1:] == which[:-1]) & (t[1:] != t[:-1]))
        own, middle = which[part], (t[part] + t[part + 1]) / 2.0
        tile_x = np.floor((x[own] + middle * dx[own]) / size).astype(np.int64)
        tile_y = np.floor((y[own] + middle * dy[own]) / size).astype(np.int64)
        follows = np.r_[False, (way[1:] == way[:-1]) & (next_x[:-1] == x[1:]) & (next_y[:-1] == y[1:])]
        on = np.r_[False, (tile_x[1:] == tile_x[:-1]) & (tile_y[1:] == tile_y[:-1]) & ((own[1:] == own[:-1]) | follows[own[1:]])]
        low_x, low_y = tile_x.min(), tile_y.min()
        wide, high = int(tile_x.max() - low_x) + 1, int(tile_y.max() - low_y) + 1
        tile = (tile_x - low_x) * high + tile_y - low_y
        pieces = np.bincount(tile[~on], minlength=wide * high)
        ways = np.cumsum(np.r_[False, way[1:] != way[:-1]])[own]
        visits = np.unique(ways[~on] * (wide * high) + tile[~on]) % (wide * high)
        found = np.flatnonzero(pieces)
        values = [found // high + low_x, found % high + low_y, pieces[found], np.bincount(visits, minlength=wide * high)[found], (pieces + np.bincount(tile, minlength=wide * high))[found]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in values], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            rows = pa.concat_tables([left, pa.Table.from_batches([b])]) if left is not None else pa.Table.from_batches([b])
            if not len(rows):
                continue
            way = rows.column("way").to_numpy()
            whole = int(np.searchsorted(way, way[-1]))  # the last way may go on in the next batch
            if whole:
                yield counts(rows.slice(0, whole))
            left = rows.slice(whole)
        if left is not None and len(left):
            yield counts(left)

    rows = segments.select(*[F.col(c).cast("long").alias(c) for c in ("way", "pos", "x", "y", "next_x", "next_y")])
    found = rows.repartition("way").sortWithinPartitions("way", "pos").mapInArrow(work, ", ".join(f"{c} long" for c in names))
    return found.groupBy("tile_x", "tile_y").agg(*[F.sum(c).alias(c) for c in names[2:]])


def quadtree(points: DataFrame, bits: int, depth: int, least: int) -> DataFrame:
    """level, prefix, n of the quadtree over points (quadtile of `bits` bits an axis): nodes of at least `least` points, down to
    `depth`, and the children of such nodes; counted at the depth, then summed upwards."""
    leaves = points.groupBy(F.shiftright("quadtile", 2 * (bits - depth)).alias("leaf")).agg(F.count("*").alias("n"))
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    counts = levels.groupBy("level", F.expr(f"shiftright(leaf, 2 * ({depth} - level))").alias("prefix")).agg(F.sum("n").alias("n"))
    full = counts.where(F.col("n") >= least).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
    kept = counts.withColumn("parent", F.shiftright("prefix", 2)).join(full, ["level", "parent"], "left_semi")
    return counts.where("level = 0").unionByName(kept.select("level", "prefix", "n"))


def in_packages(points: DataFrame, packages: DataFrame) -> DataFrame:
    """point, package, hit of the packages (package, min_x, min_y, max_x, max_y) over a point (px, py), numbered by package: a
    user's repeated clicks go through them.

    A package meets points in cells whose side is the power of two from its own longer side on, so it covers four at most
    whatever its size. A point is asked once for each such side that occurs. Crowded cells are dealt over tasks. Packages
    and points with a null among their coordinates, and packages that end before they begin, have no hits.
    """
    box = ["min_x", "min_y", "max_x", "max_y"]
    longer = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1)).cast("double")
    sized = packages.select("package", *box).na.drop(subset=box).where("min_x <= max_x and min_y <= max_y").withColumn("level", F.ceil(F.log2(longer)).cast("int"))
    levels = sorted(r.level for r in sized.select("level").distinct().collect())  # a few dozen powers of two
    if not levels:
        levels = [0]
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level")))
    wide = sized.withColumn("cx", F.explode(F.sequence(cell("min_x"), cell("max_x"))))
    covered = wide.withColumn("cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))
    asked = points.select("point", "px", "py").na.drop(subset=["px", "py"]).withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    asked = asked.withColumn("cx", cell("px")).withColumn("cy", cell("py"))
    on = F.col("px").between(F.col("min_x"), F.col("max_x")) & F.col("py").between(F.col("min_y"), F.col("max_y"))
    hits = spatial.meet(asked, covered, ["level", "cx", "cy"]).where(on).select("point", "package")
    return hits.withColumn("hit", F.row_number().over(W.partitionBy("point").orderBy("package")) - 1)


def by_quadtile(places: DataFrame, zoom: int, bits: int, tile_prefix: int) -> DataFrame:
    """places with a quadtile within one tile, given by its prefix at a zoom: a range that a sorted table prunes by."""
    low = tile_prefix << 2 * (bits - zoom)
    return places.where(F.col("quadtile").between(low, low + (1 << 2 * (bits - zoom)) - 1))
