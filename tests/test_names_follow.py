"""The stored index of names, and vehicles followed by a stateful stream that is stopped and started again."""

import datetime as dt

from pyspark.sql import functions as F

from wayfold.operators import name_index, places
from wayfold.streaming import following, gps

NAMES = [(i, n, imp) for i, (n, imp) in enumerate([("Berlin", 50), ("Berg", 3), ("bergen", 9), ("Bern", 20), ("Berg", 7), ("Ulm", 1), ("Ümlaut", 2), ("", 4), (None, 5), ("B", 1)] + [(f"Berghof {k:03d}", k % 7) for k in range(300)])]


def files_read(df):
    """Files that the scans of a plan, once run, have read."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if node.metrics().contains("numFiles"):
            found += node.metrics().apply("numFiles").value()
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return found


def test_index_answers_like_a_search_from_one_file(spark, tmp_path):
    named = spark.createDataFrame(NAMES, "id long, name string, importance int")
    path = str(tmp_path / "names")
    name_index.write(named, path, 5, 16)
    for prefix in ("", "b", "BER", "berg", "berghof 01", "Ü", "x", "ulm"):
        found = name_index.suggest(spark, path, prefix, 16)
        wanted = [tuple(r) for r in places.suggest(named.where("name <> ''"), prefix, 5).collect()]
        assert [(r.name, r.importance) for r in found.collect()] == wanted, prefix
        own = [n.lower() for _, n, _ in NAMES if n and n.lower().startswith(prefix.lower())]
        goes = name_index.continuation(spark, path, prefix, 16).collect()
        if own:
            common = max(i for i in range(len(min(own)) + 1) if min(own)[:i] == max(own)[:i])
            assert [tuple(r) for r in goes] == [(len({n for _, n, _ in NAMES if n and n.lower().startswith(prefix.lower())}), min(own)[len(prefix) : common])]
        else:
            assert goes == []
    assert files_read(name_index.suggest(spark, path, "berg", 16)) == 1
    one = name_index.by_id(spark, path, 3, 16)
    assert [r.asDict() for r in one.collect()] == [{"id": 3, "name": "Bern", "importance": 20}]
    assert files_read(name_index.by_id(spark, path, 3, 16)) == 1
    assert name_index.by_id(spark, path, 99999, 16).count() == 0
    assert name_index.prefixes(named.limit(0)).count() == 0


START = dt.datetime(2024, 5, 1, 12)
# Two waypoints eastwards along the equator; a degree is 111 km.
ROUTE = [(0.0, 0.0), (0.0, 0.02)]
TRIPS = [("a", [(0.0, 0.01), (0.0, 0.02)], ROUTE), ("b", [(0.0, 0.01)], ROUTE), ("c", [], [])]
FIXES = [  # device, seconds, lat, lon
    [("a", 0, 0.0, 0.0), ("a", 60, 0.0, 0.0099), ("a", 30, 0.0, 0.005), ("b", 10, 0.0, 0.001), ("z", 5, 0.0, 0.0), ("a", None, 0.0, 0.0)],
    [("b", 70, 0.002, 0.005), ("a", 50, 0.0, 0.02), ("a", 90, 0.0, 0.015)],
    [("b", 100, 0.0001, 0.0101), ("a", 120, 0.0, 0.0201), ("c", 110, 3.0, 3.0)],
    [("a", 5000, 0.0, 0.0201)],
    [("a", 5001, 0.0, 0.0201)],
]
WANTED = [
    ("a", 60, "passed", 1), ("a", 120, "arrived", 2), ("b", 70, "off", 0), ("b", 100, "arrived", 1), ("b", 100, "back", 1), ("c", 110, "off", 0),
    ("b", 100, "silent", 1), ("c", 110, "silent", 0),
]


def test_following_survives_a_restart(spark, tmp_path):
    trips = spark.createDataFrame(TRIPS, "device string, waypoints array<struct<lat: double, lon: double>>, route array<struct<lat: double, lon: double>>")
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    schema = "device string, ts timestamp, lat double, lon double"
    got = []
    for batch in FIXES:  # each batch is a run of its own, which goes on from the checkpoint
        spark.createDataFrame([(d, at(s), la, lo) for d, s, la, lo in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = following.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), trips)
        run = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.append((r.device, int((r.ts - START).total_seconds()), r.event, r.passed))
    assert sorted(got) == sorted(WANTED)


def test_routes_anew_from_where_a_vehicle_left(spark):
    trips = spark.createDataFrame([("b", [(0.0, 0.01), (0.0, 0.02)], ROUTE)], "device string, waypoints array<struct<lat: double, lon: double>>, route array<struct<lat: double, lon: double>>")
    nodes = spark.createDataFrame([(1, 0.002, 0.005), (2, 0.0, 0.01), (3, 0.0, 0.02), (4, 0.001, 0.007)], "node long, lat double, lon double")
    graph = spark.createDataFrame([(1, 2, 9), (1, 4, 3), (4, 2, 3), (2, 3, 5)], "source long, target long, cost long")
    events = spark.createDataFrame([("b", START, 0.0021, 0.0049, "off", 0, 222.0), ("b", START, 0.0, 0.0, "passed", 1, None)], following.EVENTS)
    found = following.reroute(events, trips, nodes, graph).orderBy("leg").collect()
    assert [(r.device, r.leg, r.cost, r.path) for r in found] == [("b", 0, 6, [1, 4, 2]), ("b", 1, 5, [2, 3])]
    half_way = events.withColumn("passed", F.lit(1))
    assert [(r.leg, r.cost) for r in following.reroute(half_way, trips, nodes, graph).collect()] == [(0, 11)]
    assert callable(gps.follow) and following.reroute(events.limit(0), trips, nodes, graph).count() == 0
