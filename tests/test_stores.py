"""Stored cells, tables laid out along quadtiles, and the source of implied tags."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from test_names_follow import files_read
from wayfold.functions import geo
from wayfold.operators import cell_store, map_store, network, spatial
from wayfold.plans import stores, tables
from wayfold.sources import implications

LINES = "way long, pos long, x long, y long, next_x long, next_y long"


@pytest.fixture(scope="module")
def cells(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    segments = network.edge_segments(tables.way_nodes(spark, small), tables.nodes(spark, small)).select("way", "pos", "x", "y", "next_x", "next_y")
    cell_store.write(segments, path, 15)
    return path, segments


def test_stored_cells_answer_like_a_rebuild_from_few_files(spark, small, cells):
    path, segments = cells
    near = tables.points(spark, small).where("px < 4000 and py < 4000")
    found = sorted(cell_store.nearest(spark, path, near, 90).collect())
    assert found and found == sorted(spatial.nearest_segment(near, segments, 90).collect())
    few, all_ = files_read(cell_store.within(spark, path, near, 90)), files_read(spark.read.parquet(f"{path}/cells"))
    assert 0 < few < all_ / 4
    assert cell_store.nearest(spark, path, near.limit(0), 90).count() == 0


def test_each_segment_is_counted_where_it_begins(spark, cells):
    path, segments = cells
    total = cell_store.overhead(spark, path).agg(F.sum("n_rows"), F.sum("n_segments")).first()
    assert total[1] == segments.count() and total[0] > total[1]


def test_cells_of_odd_segments(spark, tmp_path):
    rows = [(1, 0, 5, 5, 5, 5), (1, 1, 0, 0, 32767, 32767), (2, 0, 100, 3, 100, 32000), (2, 0, 100, 3, 100, 32000), (3, 0, None, 1, 2, 3)]
    cell_store.write(spark.createDataFrame(rows, LINES), str(tmp_path / "a"), 15)
    ask = spark.createDataFrame([(1, 5, 6), (2, 101, 20000), (3, None, 4), (4, 30000, 5)], "point long, px long, py long")
    found = {r.point: (r.way, r.pos, r.distance) for r in cell_store.nearest(spark, str(tmp_path / "a"), ask, 50).collect()}
    assert found == {1: (1, 1, 0.707), 2: (2, 0, 1.0)}
    cell_store.write(spark.createDataFrame([], LINES), str(tmp_path / "b"), 15)
    assert cell_store.nearest(spark, str(tmp_path / "b"), ask, 50).count() == 0


VIEWS = [map_store.View(0.4, 0.6, 640, 400, 6), map_store.View(0.41, 0.61, 640, 400, 13), map_store.View(0.0, 1.0, 900, 900, 4), map_store.View(0.5, 0.5, 64, 64, 15), map_store.View(3.0, 0.5, 64, 64, 5)]


def test_a_view_opens_few_files_and_shows_what_lies_in_its_tiles(spark, small, tmp_path):
    nodes = tables.nodes(spark, small).unionByName(tables.nodes(spark, small).select(F.col("node") + 100_000, ((F.col("x") * 3) % 32768).alias("x"), ((F.col("y") * 5) % 32768).alias("y")).toDF("node", "x", "y"))
    for name, rows in (("nodes", nodes.withColumn("quadtile", geo.quadtile(F.col("x"), F.col("y")))), ("ways", stores.way_pieces(spark, small))):
        path = str(tmp_path / name)
        map_store.write(rows, path, files=16)
        stored = spark.read.parquet(f"{path}/rows")
        index = spark.read.parquet(f"{path}/index").collect()
        assert sum(r.n for r in index) == rows.count() and len(index) > 8
        for view in VIEWS:
            tiles = {(r.zoom, r.tile_x, r.tile_y) for r in map_store.covers(spark.createDataFrame([(1, *vars(view).values())], "view int, x double, y double, width int, height int, zoom int")).collect()}
            found = map_store.shown(spark, path, view, 15)
            x, y = geo.quadtile_xy(F.col("quadtile"))
            wanted = [r.quadtile for r in stored.select("quadtile", x.alias("x"), y.alias("y")).collect() if any((r.x >> (15 - z), r.y >> (15 - z)) == (a, b) for z, a, b in tiles)]
            assert sorted(r.quadtile for r in found.collect()) == sorted(wanted), view
            assert bool(tiles) == bool(map_store.ranges(view, 15))
        assert files_read(map_store.shown(spark, path, VIEWS[1], 15)) <= 3


def test_row_groups_beside_the_view_are_not_read(spark, tmp_path):
    rows = spark.range(0, 1 << 20).select(F.col("id").alias("quadtile"), F.hex(F.xxhash64("id")).alias("data"))
    session = {"parquet.block.size": str(1 << 18)}
    path = str(tmp_path / "rows")
    rows.repartitionByRange(1, "quadtile").sortWithinPartitions("quadtile").write.options(**session).parquet(f"{path}/rows")
    found = spark.read.parquet(f"{path}/rows").where("quadtile between 500000 and 500010")
    assert found.count() == 11
    found.collect()
    scans, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numFiles"):
            scans.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 11 <= scans[0] < (1 << 20) / 4


def test_start_view(spark):
    rows = spark.createDataFrame([(0, 0), (100, 300)], "x long, y long")
    assert tuple(map_store.start_view(rows, 10).first()) == (50 / 1024, 150 / 1024)
    assert tuple(map_store.start_view(rows.where("x > 1000"), 10).first()) == (None, None)


PAGES = [
    ("en", "highway", "motorway", "oneway=yes,layer=0"), ("en", "highway", "motorway", "lit=yes"), ("de", "highway", "motorway", "oneway=no"),
    # two values of one implied key, apart in the order of values
    ("en", "junction", "roundabout", "oneway=a"), ("en", "junction", "roundabout", "access=b"), ("en", "junction", "roundabout", "oneway=c"),
    ("en", "bridge", None, "layer=1"), ("en", "x", "y", "broken,a=,=b,a=b=c"), ("en", "e", "f", ""), ("en", "n", "o", None), ("fr';--", "k", "v", "a=b"), (None, "k", "v", "a=b"),
]


@pytest.fixture(scope="module")
def wiki(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wiki")
    for k in range(2):
        with sqlite3.connect(folder / f"pages {k}.db") as db:
            db.execute("CREATE TABLE wikipages (lang TEXT, key TEXT, value TEXT, extra BLOB, tags_implies TEXT)")
            db.executemany("INSERT INTO wikipages (lang, key, value, tags_implies) VALUES (?, ?, ?, ?)", PAGES[k::2])
        db.close()
    return str(folder / "pages *.db")


def test_implied_tags_by_language(spark, wiki):
    rows = lambda lang: sorted(tuple(r) for r in implications.implied(spark, wiki, lang).collect())
    assert rows("en") == [
        ("bridge", "", "layer", "1"), ("highway", "motorway", "layer", "0"), ("highway", "motorway", "lit", "yes"), ("highway", "motorway", "oneway", "yes"), ("junction", "roundabout", "access", "b"),
    ]
    assert rows("de") == [("highway", "motorway", "oneway", "no")]
    assert rows("fr';--") == [("k", "v", "a", "b")]
    assert rows("xx") == []


def test_the_language_reaches_the_source(spark, wiki):
    pages = implications.pages(spark, wiki, 2)
    assert pages.count() == len(PAGES) and pages.rdd.getNumPartitions() == 6
    found = pages.where("lang = 'de'")
    assert found.count() == 1
    found.collect()
    todo, rows = [found._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "Scan" in node.getClass().getSimpleName() and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert rows == [1]
    assert pages.where("lang in ('de', 'en') and key like 'h%'").count() == 3


def test_filters_that_the_source_takes():
    reader = implications._Reader([], 10)
    left = [implications.EqualTo(("lang",), "en"), implications.In(("key",), ("a", "b")), implications.EqualTo(("lang",), None), implications.EqualTo(("other",), "x")]
    assert list(reader.pushFilters(left)) == left[2:]
    assert reader.where == ['"lang" IN (?)', '"key" IN (?, ?)'] and reader.values == ["en", "a", "b"]
