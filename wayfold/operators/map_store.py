"""Map tables laid out along quadtiles: what a view of the map shows is a few ranges of a sorted table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.numbering import cut, drop

#: The side of a tile in pixels, and the zoom beyond which tiles are loaded by those that hold them.
TILE, LOADED = 256, 12


@dataclass
class View:
    """A window of pixels about a centre, given in parts of the map's side (0 to 1)."""

    x: float
    y: float
    width: int
    height: int
    zoom: int


def _span(centre: Column, pixels: Column, zoom: Column) -> Column:
    """First and last tile along an axis, those beyond the map's border left out."""
    side = F.pow(F.lit(2.0), zoom)
    low, high = F.floor(centre * side - pixels / (2.0 * TILE)), F.ceil(centre * side + pixels / (2.0 * TILE)) - 1
    return F.struct(F.greatest(low, F.lit(0)).cast("long").alias("low"), F.least(high, side.cast("long") - 1).cast("long").alias("high"))


def covers(views: DataFrame, key: str = "view") -> DataFrame:
    """key, zoom, tile_x, tile_y of the tiles to load for views (key, x, y in parts of the map's side, width, height in pixels,
    zoom): those under the window, at zooms over LOADED the tiles of that zoom that hold them, each once. A view beside
    the map, or with a null, has none."""
    spans = views.select(key, "zoom", _span(F.col("x"), F.col("width"), F.col("zoom")).alias("sx"), _span(F.col("y"), F.col("height"), F.col("zoom")).alias("sy"))
    up = lambda v: F.expr(f"shiftright({v}, greatest(zoom - {LOADED}, 0))")
    on = spans.where("sx.low <= sx.high and sy.low <= sy.high")
    # Ends first are brought to the zoom that is loaded, so that no tile occurs twice.
    across = on.select(key, F.least("zoom", F.lit(LOADED)).alias("zoom"), F.explode(F.sequence(up("sx.low"), up("sx.high"))).alias("tile_x"), F.sequence(up("sy.low"), up("sy.high")).alias("ys"))
    return across.select(key, "zoom", "tile_x", F.explode("ys").alias("tile_y"))


def _interleave(x: int, y: int, levels: int) -> int:
    return sum(((x >> i & 1) << 1 | (y >> i & 1)) << 2 * i for i in range(levels))


def ranges(view: View, bits: int) -> list[tuple[int, int]]:
    """The quadtiles of `bits` bits an axis under a view, as ranges (first, last), neighbours joined. One view has as many as
    its window has tiles at most."""
    zoom, side = min(view.zoom, LOADED), 2.0**view.zoom
    axis = {}
    for v, pixels in (("x", view.width), ("y", view.height)):
        at = getattr(view, v) * side
        low, high = max(0, math.floor(at - pixels / (2.0 * TILE))), min(int(side) - 1, math.ceil(at + pixels / (2.0 * TILE)) - 1)
        axis[v] = range(low >> (view.zoom - zoom), (high >> (view.zoom - zoom)) + 1) if low <= high else range(0)
    size = 1 << 2 * (bits - zoom) if bits >= zoom else 1
    drop = max(0, zoom - bits)
    found: list[tuple[int, int]] = []
    for tile in sorted({_interleave(x >> drop, y >> drop, zoom - drop) for x in axis["x"] for y in axis["y"]}):
        first, last = tile * size, (tile + 1) * size - 1
        if found and found[-1][1] + 1 == first:
            found[-1] = (found[-1][0], last)
        else:
            found.append((first, last))
    return found


def write(rows: DataFrame, path: str, files: int | None = None, order: list[str] | None = None) -> None:
    """Store rows (quadtile, ..) in files of one range of quadtiles each, about as many rows in every file, sorted by quadtile,
    then by `order`; and the index of the files (file, first, last, n). Rows without a quadtile are left out.

    Spark chooses the ranges from a sample, so rows are written once before, not computed twice. Rows of one quadtile are kept together only as far as `order` doesn't tell them
    apart: ranges are over both, so a crowded tile is spread over several files.
    """
    spark, keys = rows.sparkSession, ["quadtile", *(order or [])]
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = cut(rows.where("quadtile is not null"))
    made.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows")
    drop(made)
    stored = spark.read.parquet(f"{path}/rows").select("quadtile", F.col("_metadata.file_path").alias("file"))
    index = stored.groupBy("file").agg(F.min("quadtile").alias("first"), F.max("quadtile").alias("last"), F.count("*").alias("n"))
    index.coalesce(1).sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/index")


def shown(spark: SparkSession, path: str, view: View, bits: int) -> DataFrame:
    """The stored rows under a view. Only files whose range meets it are opened (the index has a row a file), and of these only
    row groups that may hold its quadtiles are read."""
    asked = ranges(view, bits)
    schema = spark.read.parquet(f"{path}/rows").schema
    meets = lambda first, last: F.expr(" or ".join(f"({last} >= {a}L and {first} <= {b}L)" for a, b in asked) or "false")
    files = [r.file for r in spark.read.parquet(f"{path}/index").where(meets("first", "last")).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(meets("quadtile", "quadtile"))


def start_view(rows: DataFrame, bits: int) -> DataFrame:
    """x, y of the centre of the box about all rows (x, y; whole coordinates of `bits` bits), in parts of the map's side: where
    a map is first shown. Null for no rows."""
    middle = lambda v: ((F.min(v) + F.max(v)) / 2.0 / float(1 << bits)).alias(v)
    return rows.agg(middle("x"), middle("y"))
