"""The k nearest targets of every point, without a radius, by cells as small as targets are dense.

Points and targets meet in blocks of the map first, targets within some distance of a block too; a task finds what is nearest
there, and that is final if what was not sent is further away. Points for which it isn't, few unless targets lie crowded, are
searched by cells.

Cells are those of a quadtree. A point's smallest cell that holds k targets bounds how far the k-th can be; cells within
that bound are then split, level by level, as long as they hold more than k targets, and each level tightens the bound by
the counts alone. Targets at one place are reduced to the k that can count, and points at one place are searched once, so
neither a crowded place nor a crowded cell is compared in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from wayfold.functions import geo
from wayfold.operators.near_lines import ranges
from wayfold.operators.numbering import cut, drop, shuffled

#: Levels whose cells, at most 4 to their power, are broadcast.
SHARED = 6
#: Usual points and targets of a block, points of a block that one task takes, and targets beyond which a block is left to the cells.
BLOCK_POINTS, BLOCK_TARGETS, TASK_POINTS, CROWDED = 25_000, 50_000, 200_000, 1_000_000
#: Targets that a point of a block is compared with at most, lest it is left to the cells, and pairs compared at once.
COMPARED, PAIRS = 4096, 1_000_000


@dataclass
class Cells:
    """An index of targets: cells (level, prefix, n, leaf), and targets by leaf (leaf, leaf_prefix, id, x, y). A leaf is the
    largest cell of at most k targets over a place; `leaf` of a cell beyond it is the leaf's level, else null."""

    cells: DataFrame
    targets: DataFrame
    bits: int
    k: int


def index(targets: DataFrame, k: int, bits: int, ident: str = "id") -> Cells:
    """Cells over targets (ident, x, y: whole numbers of `bits` bits, 31 at most). Targets without coordinates are left out."""
    rows = targets.where("x is not null and y is not null").select(F.col(ident).alias("id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    first = F.row_number().over(W.partitionBy("x", "y").orderBy("id"))
    rows = cut(rows.withColumn("__k", first).where(F.col("__k") <= k).drop("__k").withColumn("q", geo.quadtile(F.col("x"), F.col("y"))))
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")
    deep = F.expr(f"shiftright(q, 2 * ({bits} - level))").alias("prefix")
    paths = rows.groupBy("q").agg(F.count("*").alias("m")).select("q", "m", levels).select("q", "m", "level", deep)
    counts = cut(paths.groupBy("level", "prefix").agg(F.sum("m").alias("n")))
    known = shuffled(paths).join(shuffled(counts), ["level", "prefix"])
    known = known.withColumn("leaf", F.min(F.when(F.col("n") <= k, F.col("level"))).over(W.partitionBy("q")))
    cells = cut(known.groupBy("level", "prefix").agg(F.first("n").alias("n"), F.min(F.when(F.col("level") >= F.col("leaf"), F.col("leaf"))).alias("leaf")))
    leaves = known.where("level = leaf").select("q", "leaf", F.col("prefix").alias("leaf_prefix"))
    placed = cut(shuffled(rows).join(shuffled(leaves), "q").select("leaf", "leaf_prefix", "id", "x", "y"))
    drop(counts, rows)
    return Cells(cells, placed, bits, k)


def _corner(v: str, low: Column, side: Column, far: bool) -> Column:
    """Distance along an axis from a point to the near or far side of a cell."""
    high = low + side - 1
    return F.greatest(F.abs(F.col(v) - low), F.abs(F.col(v) - high)) if far else F.greatest(low - F.col(v), F.lit(0), F.col(v) - high)


def _reach(rows: DataFrame, bits: int, k: int) -> DataFrame:
    """rows (px, py, level, prefix, n, leaf, bound2) with bound2 as tight as the counts allow, and only cells within it."""
    side = F.expr(f"shiftleft(1L, {bits} - level)")
    cx, cy = geo.quadtile_xy(F.col("prefix"))
    near2 = sum((_corner(v, c * side, side, False) * _corner(v, c * side, side, False) for v, c in (("px", cx), ("py", cy))), F.lit(0))
    far2 = sum((_corner(v, c * side, side, True) * _corner(v, c * side, side, True) for v, c in (("px", cx), ("py", cy))), F.lit(0))
    rows = rows.withColumns({"near2": near2, "far2": far2})
    point = W.partitionBy("px", "py")
    held = F.sum("n").over(point.orderBy("far2").rangeBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("held", held)
    tight = F.min(F.when(F.col("held") >= k, F.col("far2"))).over(point)
    rows = rows.withColumn("bound2", F.least("bound2", tight))
    return rows.where("bound2 is null or near2 <= bound2").select("px", "py", "level", "prefix", "n", "leaf", "bound2")


def search(places: DataFrame, cells: Cells) -> DataFrame:
    """px, py, rank, id, d2 of the k nearest targets of each place (px, py, distinct), ties by id."""
    bits, k = cells.bits, cells.k
    places = cut(places)
    full = cells.cells.where(F.col("n") >= k).select("level", "prefix")
    levels = places.select("px", "py", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"))
    levels = levels.withColumn("prefix", F.shiftright(geo.quadtile(F.col("px"), F.col("py")), 0)).withColumn("prefix", F.expr(f"shiftright(prefix, 2 * ({bits} - level))"))
    upper = levels.where(F.col("level") <= SHARED).join(F.broadcast(full.where(F.col("level") <= SHARED)), ["level", "prefix"])  # 4 ** SHARED cells a level at most
    lower = shuffled(levels.where(F.col("level") > SHARED)).join(shuffled(full.where(F.col("level") > SHARED)), ["level", "prefix"])
    start = upper.select("px", "py", "level").union(lower.select("px", "py", "level")).groupBy("px", "py").agg(F.max("level").alias("level"))
    start = shuffled(places).join(shuffled(start), ["px", "py"], "left").withColumn("known", F.col("level").isNotNull()).na.fill(0, ["level"])
    side = F.expr(f"shiftleft(1L, {bits} - level)")
    own = lambda v: F.floor(F.col(v) / side) * side
    far2 = sum((_corner(v, own(v), side, True) * _corner(v, own(v), side, True) for v in ("px", "py")), F.lit(0))
    start = start.withColumn("bound2", F.when(F.col("known"), far2))
    reach = F.ceil(F.sqrt("bound2"))
    last = F.expr("shiftleft(1L, level) - 1")
    span = lambda v: F.when(F.col("bound2").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.greatest(F.floor((F.col(v) - reach) / side), F.lit(0)), F.least(F.floor((F.col(v) + reach) / side), last))
    )
    around = start.select("px", "py", "level", "bound2", F.explode(span("px")).alias("cx"), span("py").alias("ys"))
    around = around.select("px", "py", "level", "bound2", "cx", F.explode("ys").alias("cy")).withColumn("prefix", geo.quadtile(F.col("cx"), F.col("cy")))
    front = cut(_reach(shuffled(around).join(shuffled(cells.cells), ["level", "prefix"]), bits, k))
    while not front.where("leaf is null").isEmpty():
        split = front.where("leaf is null").select("px", "py", "bound2", (F.col("level") + 1).alias("level"), F.explode(F.array(*[F.shiftleft("prefix", 2) + i for i in range(4)])).alias("prefix"))
        inner = shuffled(split).join(shuffled(cells.cells), ["level", "prefix"]).select(*front.columns)
        new = cut(_reach(front.where("leaf is not null").unionByName(inner), bits, k))
        drop(front)
        front = new
    leaves = front.select("px", "py", "bound2", "leaf", F.expr("shiftright(prefix, 2 * (level - leaf))").alias("leaf_prefix"))
    leaves = leaves.groupBy("px", "py", "leaf", "leaf_prefix").agg(F.max("bound2").alias("bound2"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    hits = shuffled(leaves).join(shuffled(cells.targets), ["leaf", "leaf_prefix"]).withColumn("d2", dx * dx + dy * dy).where("bound2 is null or d2 <= bound2")
    rank = F.row_number().over(W.partitionBy("px", "py").orderBy("d2", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("px", "py", "rank", "id", "d2")


class Near:
    """Targets (id, x, y) sent to a block, with the sides of the region from which all targets were sent (infinite if there are none
    beyond)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, region: tuple[float, float, float, float], k: int):
        self.region, self.k = region, k
        self.low_x, self.low_y = (int(v.min()) if len(v) else 0 for v in (x, y))
        width, height = (int(v.max()) - low + 1 if len(v) else 1 for v, low in ((x, self.low_x), (y, self.low_y)))
        self.size = max(1, math.ceil((2.0 * width * height / max(1, len(ids))) ** 0.5), math.ceil(max(width, height) / 4096))
        self.wide, self.high = -(-width // self.size), -(-height // self.size)
        cell = (y - self.low_y) // self.size * self.wide + (x - self.low_x) // self.size
        order = np.argsort(cell, kind="stable")
        self.ids, self.x, self.y = ids[order], x[order], y[order]
        self.held = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.wide * self.high))])

    def of(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(point, rank, id, d2) of the nearest targets of the points that are final, and the other points."""
        cx, cy = np.clip((px - self.low_x) // self.size, 0, self.wide - 1), np.clip((py - self.low_y) // self.size, 0, self.high - 1)
        found, left, over, reach = [], np.arange(len(px)), [], 1
        while len(left):
            west, east = np.maximum(cx[left] - reach, 0), np.minimum(cx[left] + reach, self.wide - 1)
            south, north = np.maximum(cy[left] - reach, 0), np.minimum(cy[left] + reach, self.high - 1)
            # What lies outside the cells looked at is further away than this; beyond the last cells, than the region's sides.
            x, y, (x0, x1, y0, y1) = px[left], py[left], self.region
            margin = np.minimum.reduce([
                np.where(west > 0, x - (self.low_x + west * self.size), x - x0), np.where(east < self.wide - 1, self.low_x + (east + 1) * self.size - 1 - x, x1 - x),
                np.where(south > 0, y - (self.low_y + south * self.size), y - y0), np.where(north < self.high - 1, self.low_y + (north + 1) * self.size - 1 - y, y1 - y),
            ])
            which, row = ranges(south, north + 1)
            begin, end = self.held[row * self.wide + west[which]], self.held[row * self.wide + east[which] + 1]
            n = np.bincount(which, end - begin, len(left)).astype(np.int64)
            whole = (west == 0) & (east == self.wide - 1) & (south == 0) & (north == self.high - 1)
            many = n > COMPARED
            final, sums = np.zeros(len(left), bool), np.cumsum(np.where(many, 0, n))
            for part in range(int(sums[-1] // PAIRS) + 1):
                own = np.flatnonzero((sums // PAIRS == part) & ~many & ((n >= self.k) | (whole & np.isinf(margin))))
                if not len(own):
                    continue
                rows = np.flatnonzero(np.isin(which, own)) if len(own) < len(left) else np.arange(len(which))
                p, j = ranges(begin[rows], end[rows])
                p = which[rows][p]
                d2 = (self.x[j] - x[p]) ** 2 + (self.y[j] - y[p]) ** 2
                order = np.lexsort((self.ids[j], d2, p))
                p, j, d2 = p[order], j[order], d2[order]
                rank = np.arange(len(p)) - np.searchsorted(p, p) + 1
                last = np.zeros(len(left))
                near = rank <= self.k
                p, j, d2, rank = p[near], j[near], d2[near], rank[near]
                np.maximum.at(last, p, d2)
                final[own] = last[own] <= np.where(margin[own] < 0, -1.0, margin[own] ** 2)
                ok = final[p]
                found.append((left[p[ok]], rank[ok], self.ids[j[ok]], d2[ok]))
            over.append(left[~final & (many | whole)])
            left, reach = left[~final & ~many & ~whole], 2 * reach + 1
        return *(np.concatenate(v) if found else np.empty(0, np.int64) for v in (zip(*found) if found else [()] * 4)), np.concatenate([np.empty(0, np.int64), *over])


def _in_blocks(asked: DataFrame, targets: DataFrame, k: int, key: str) -> DataFrame:
    """key, px, py, rank, id, d2 by blocks: px and py are null but for points that are left, which have nothing else. targets:
    id, x, y, at most k of a place."""
    spark, kind = asked.sparkSession, asked.schema[key].dataType
    n, low_x, high_x, low_y, high_y = targets.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("px long, py long, rank int, id long, d2 long").fields])
    if not n:
        return spark.createDataFrame([], schema)
    span = max(high_x - low_x, high_y - low_y) + 1
    wide = math.ceil(max(n / BLOCK_TARGETS, asked.count() / BLOCK_POINTS, 1) ** 0.5)
    side = math.ceil(span / wide)
    halo = math.ceil(2 * (k * float(high_x - low_x + 1) * float(high_y - low_y + 1) / (math.pi * n)) ** 0.5)
    halo = min(halo, side)
    at = lambda v, low: F.least(F.greatest(F.floor((v - low) / side), F.lit(0)), F.lit(wide - 1)).cast("long")
    around = lambda v, low: F.sequence(at(F.col(v) - halo, low), at(F.col(v) + halo, low))
    spread = targets.select("id", "x", "y", F.explode(around("x", low_x)).alias("bx"), around("y", low_y).alias("ys")).select("id", "x", "y", "bx", F.explode("ys").alias("by"))
    own = asked.select(key, "px", "py", at(F.col("px"), low_x).alias("bx"), at(F.col("py"), low_y).alias("by"))
    crowded = {(r.bx, r.by) for r in spread.groupBy("bx", "by").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).collect()}
    counts = sorted((r.bx, r.by, r.n) for r in own.groupBy("bx", "by").agg(F.count("*").alias("n")).collect())  # a row a block
    if not counts:
        return spark.createDataFrame([], schema)
    parts = [math.ceil(m / TASK_POINTS) for *_, m in counts]
    firsts = np.cumsum([0, *parts]).tolist()
    layout = F.broadcast(spark.createDataFrame([(bx, by, p, f, (bx, by) in crowded) for (bx, by, _), p, f in zip(counts, parts, firsts)], "bx long, by long, parts int, first int, crowded boolean"))  # a row a block
    none = lambda *named: [F.lit(None).cast(t).alias(c) for c, t in named]
    of_point = (F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int").alias("group")
    points = own.join(layout, ["bx", "by"]).select(of_point, "bx", "by", "crowded", key, "px", "py", *none(("id", "long")))
    sent = spread.join(layout, ["bx", "by"]).where("not crowded").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("group"), "bx", "by", "crowded", F.lit(None).cast(kind).alias(key), F.col("x").alias("px"), F.col("y").alias("py"), "id")
    last = wide - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, near, waiting = None, None, []
        for b in batches:
            of, is_point = b.column("group").to_numpy(), np.asarray(b.column("id").is_null())
            ends = [*(np.flatnonzero((of[1:] != of[:-1]) | (is_point[1:] != is_point[:-1])) + 1).tolist(), len(of)] if len(of) else []
            for start, end in zip([0, *ends[:-1]], ends):
                rows = b.slice(start, end - start)
                if of[start] != group:
                    group, near, waiting = of[start], None, []
                px, py = (rows.column(c).to_numpy() for c in ("px", "py"))
                if not is_point[start]:
                    waiting.append((rows.column("id").to_numpy(), px, py))
                    continue
                if near is None:
                    bx, by = rows.column("bx")[0].as_py(), rows.column("by")[0].as_py()
                    edges = lambda at, low: (low + at * side - halo if at > 0 else -math.inf, low + (at + 1) * side + halo - 1 if at < last else math.inf)
                    ids, x, y = (np.concatenate(v) for v in zip(*waiting)) if waiting else [np.empty(0, np.int64)] * 3
                    near = Near(ids, x, y, (*edges(bx, low_x), *edges(by, low_y)), k)
                if rows.column("crowded")[0].as_py():
                    p, rank, found, d2, left = *[np.empty(0, np.int64)] * 4, np.arange(len(px))
                else:
                    p, rank, found, d2, left = near.of(px, py)
                keys = rows.column(key)
                void = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(p)), void, void, pa.array(rank.astype(np.int32)), pa.array(found), pa.array(d2)], names=schema.names)
                void = pa.nulls(len(left), pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(left)), pa.array(px[left]), pa.array(py[left]), void.cast(pa.int32()), void, void], names=schema.names)

    dealt = points.unionByName(sent).repartitionById(firsts[-1], "group").sortWithinPartitions("group", F.col("id").isNull())
    return dealt.mapInArrow(work, schema)


def k_nearest(points: DataFrame, targets: DataFrame, k: int, bits: int, key: str = "point", ident: str = "id") -> DataFrame:
    """key, rank, ident, d2 of the k targets (ident, x, y) nearest to each point (key, px, py), ties by ident; all targets
    where there are fewer than k. Coordinates are whole numbers of `bits` bits. Points without coordinates have none."""
    asked = cut(points.where("px is not null and py is not null").select(key, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")))
    rows = targets.where("x is not null and y is not null").select(F.col(ident).alias("id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    first = F.row_number().over(W.partitionBy("x", "y").orderBy("id"))
    rows = cut(rows.withColumn("__k", first).where(F.col("__k") <= k).drop("__k"))
    found = cut(_in_blocks(asked, rows, k, key))
    done, left = found.where("px is null"), found.where("px is not null")
    done = done.select(key, "rank", F.col("id").alias(ident), "d2")
    if left.isEmpty():
        return done
    more = search(left.select("px", "py").distinct(), index(rows, k, bits))
    return done.unionByName(shuffled(left.select(key, "px", "py")).join(shuffled(more), ["px", "py"]).select(key, "rank", F.col("id").alias(ident), "d2"))
