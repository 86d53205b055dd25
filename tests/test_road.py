"""Every road query against its SQL, and the pieces on small hand-made tables."""

import heapq

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import network, routing
from wayfold.plans import names, osm, places_near, road, stores, streets  # noqa: F401  all queries are in one registry
from wayfold.sources import readers
from wayfold.streaming import gps


@pytest.mark.parametrize("name", sorted(road.ORACLES))
def test_query_equals_sql(spark, small, duck, rows_of, name):
    found, wanted = road.QUERIES[name](spark, small).toPandas(), duck.sql(road.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(52.5, 13.4), (-33.9, 151.2), (0.0, 0.0)], "lat double, lon double")
    back = rows.select("lat", "lon", geo.latitude(geo.mercator_y(F.col("lat"))).alias("la"), geo.longitude(geo.mercator_x(F.col("lon"))).alias("lo")).collect()
    assert all(abs(r.lat - r.la) < 1e-9 and abs(r.lon - r.lo) < 1e-9 for r in back)


def test_way_without_all_coordinates_is_dropped(spark):
    ways = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 10, 0), (2, 99, 1)], "way long, node long, pos long")
    xy = spark.createDataFrame([(10, 0, 0), (11, 3, 4)], "node long, x long, y long")
    assert [r.way for r in network.edge_segments(ways, xy).collect()] == [1]


def test_distances_against_hand_count(spark):
    graph = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1)], "source long, target long, cost long")
    found = routing.distances(graph, spark.createDataFrame([(1,)], "origin long"), 9)
    assert {(r.node, r.cost) for r in found.collect()} == {(1, 0), (2, 5), (3, 10), (4, 11)}


def dijkstra(edges):
    """(origin, node, cost) of all nodes of edges (source, target, cost)."""
    out = {}
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
        out.setdefault(b, [])
    found = set()
    for origin in out:
        done, heap = {}, [(0, origin)]
        while heap:
            cost, node = heapq.heappop(heap)
            if node not in done:
                done[node] = cost
                for b, c in out[node]:
                    heapq.heappush(heap, (cost + c, b))
        found |= {(origin, node, cost) for node, cost in done.items()}
    return found


def test_shortest_paths_of_many_edges(spark):
    edges = [(k, k + 1, 1) for k in range(11)] + [(0, 7, 100), (11, 5, 2), (20, 21, 3), (20, 21, 2), (21, 21, 1)]
    graph = spark.createDataFrame(edges, "source long, target long, cost long")
    origins = spark.createDataFrame([(n,) for n in [*range(12), 20, 21, 21]], "origin long")
    wanted = dijkstra(edges)
    assert (0, 7, 7) in wanted and (0, 11, 11) in wanted
    for pairs in (50, 1000):
        found = [tuple(r) for r in routing.shortest_paths(graph, origins, pairs).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_shortest_paths_from_every_node(spark, small):
    _, graph = road._routing_edges(spark, small)
    found = [tuple(r) for r in road.QUERIES["shortest_paths"](spark, small).select("origin", "node", "cost").collect()]
    assert len(found) == len(set(found)) and set(found) == dijkstra([tuple(r) for r in graph.collect()])


def test_title_case_and_speeds(spark):
    rows = spark.createDataFrame([("NEW YORK-ON tweed", "30 mph"), ("a", "signals"), (None, None)], "n string, s string")
    out = rows.select(geo.title_case(F.col("n")).alias("n"), geo.max_speed_kmh(F.col("s")).alias("s")).collect()
    assert out[0].n == "New York-On Tweed" and abs(out[0].s - 48.28032) < 1e-9 and out[1].s is None and out[2].n is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        '<osm><node id="1" lat="1.5" lon="2.5"><tag k="name" v="A"/><tag k="x" v="y"/></node><node id="5000000000" lat="0" lon="0"/>'
        '<way id="7"><nd ref="1"/><nd ref="5000000000"/><tag k="highway" v="primary"/></way>'
        '<relation id="9"><member type="way" ref="7" role="from"/></relation></osm>'
    )
    path = str(tmp_path / "a.osm")
    nodes = {r.id: r for r in readers.osm_xml(spark, path, "node", ["name"]).collect()}
    assert [t.k for t in nodes[1].tags] == ["name"] and nodes[5000000000].tags == []
    assert readers.osm_xml(spark, path, "way").first().nodes == [1, 5000000000]
    assert readers.osm_xml(spark, path, "relation").first().members[0].role == "from"
    (tmp_path / "g.ddsg").write_text("d\n3 4\n1 2 5 0\n2 3 6 2\n3 1 1 3\n2 2 1 0\n")
    got = {tuple(r) for r in readers.ddsg(spark, str(tmp_path / "g.ddsg")).collect()}
    assert got == {(1, 2, 5, True, True), (2, 3, 6, False, True)}
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg><trkseg><trkpt lat="4" lon="5"><time>2024-01-01T00:01:00Z</time></trkpt></trkseg></trk></gpx>')
    assert [(r.segment, r.lat) for r in readers.gpx(spark, str(tmp_path / "t.gpx")).orderBy("segment").collect()] == [(0, 1.0), (1, 4.0)]
    assert readers.profile(spark, "[primary]\nmax_speed=100\naverage=80\n").first().average == 80.0


def test_gps_reports_and_stream(spark, tmp_path):
    lines = ['{"class":"TPV","device":"a","mode":3,"time":"2024-01-01T00:00:%02dZ","lat":1.0,"lon":2.0,"alt":5.0,"epx":1.0,"epy":2.0}' % i for i in range(3)]
    lines += ['{"class":"SKY"}', '{"class":"TPV","device":"a","mode":2,"time":"2024-01-01T01:00:00Z","lat":1.0,"lon":2.0,"alt":5.0}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join(lines))
    rows = gps.reports(spark.read.text(str(tmp_path / "in"))).orderBy("ts").collect()
    assert len(rows) == 4 and rows[0].alt == 5.0 and rows[0].accuracy == 2.0 and rows[3].alt is None
    assert gps.latest(gps.reports(spark.read.text(str(tmp_path / "in")))).first().alt == 5.0
    stream = gps.stream_segments(gps.reports(spark.readStream.text(str(tmp_path / "in"))))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("segments").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.fixes for r in spark.table("segments").collect()) == [1, 3]


def pb(number, value):
    """One field of a message: bytes, or an integer."""
    vi = lambda v: bytes([v & 127 | 128]) + vi(v >> 7) if v > 127 else bytes([v])
    return vi(number << 3 | 2) + vi(len(value)) + value if isinstance(value, bytes) else vi(number << 3) + vi(value)


def packed(values, signed=False, delta=False):
    vi = lambda v: bytes([v & 127 | 128]) + vi(v >> 7) if v > 127 else bytes([v])
    out, last = b"", 0
    for v in values:
        d, last = (v - last, v) if delta else (v, last)
        out += vi((d << 1) ^ (d >> 63) if signed else d)
    return out


OSM_NODES = {1: (52.0, 13.0, []), 2: (52.001, 13.0, [("highway", "traffic_signals")]), 3: (52.002, 13.0, [("barrier", "gate")]), 4: (52.002, 13.002, []), 5: (52.001, 13.002, []), 6: (52.01, 13.01, [("place", "town"), ("name", "Alt")])}
OSM_WAYS = {
    10: ([1, 2, 3, 4], [("highway", "primary"), ("name", "Long  Road"), ("maxspeed", "30 mph")]),
    11: ([2, 5], [("highway", "residential"), ("oneway", "-1")]),
    12: ([4, 5, 2], [("junction", "roundabout"), ("highway", "primary")]),
    13: ([1, 99], [("highway", "primary")]),
    14: ([1, 5], [("highway", "footway")]),
}


def pbf_file(path, features=(b"OsmSchema-V0.6", b"DenseNodes")):
    import struct
    import zlib

    text = [""]
    at = lambda s: text.index(s) if s in text else (text.append(s), len(text) - 1)[1]
    pairs = [x for n in OSM_NODES.values() for x in [*(at(s) for kv in n[2] for s in kv), 0]]
    dense = pb(1, packed(OSM_NODES, True, True)) + pb(8, packed([round(n[0] * 1e7) for n in OSM_NODES.values()], True, True)) + pb(9, packed([round(n[1] * 1e7) for n in OSM_NODES.values()], True, True)) + pb(10, packed(pairs))
    ways = b"".join(pb(3, pb(1, i) + pb(2, packed([at(k) for k, _ in t])) + pb(3, packed([at(v) for _, v in t])) + pb(8, packed(n, True, True))) for i, (n, t) in OSM_WAYS.items())
    rel = pb(4, pb(1, 20) + pb(2, packed([at("type"), at("restriction")])) + pb(3, packed([at("restriction"), at("no_left_turn")])) + pb(8, packed([at("from"), at("via"), at("to")])) + pb(9, packed([10, 2, 11], True, True)) + pb(10, packed([1, 0, 1])))
    block = pb(1, b"".join(pb(1, s.encode()) for s in text)) + pb(2, pb(2, dense)) + pb(2, ways) + pb(2, rel)
    out = b""
    for kind, body, raw in ((b"OSMHeader", b"".join(pb(4, f) for f in features), True), (b"OSMData", block, False)):
        blob = pb(1, body) if raw else pb(2, len(body)) + pb(3, zlib.compress(body))
        head = pb(1, kind) + pb(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    path.write_bytes(out)


def xml_text():
    tags = lambda t: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t)
    nodes = "".join(f'<node id="{i}" lat="{a}" lon="{b}">{tags(t)}</node>' for i, (a, b, t) in OSM_NODES.items())
    ways = "".join(f'<way id="{i}">{"".join(f"<nd ref={chr(34)}{n}{chr(34)}/>" for n in ns)}{tags(t)}</way>' for i, (ns, t) in OSM_WAYS.items())
    members = '<member type="way" ref="10" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="11" role="to"/>'
    return f'<osm>{nodes}{ways}<relation id="20">{members}{tags([("type", "restriction"), ("restriction", "no_left_turn")])}</relation></osm>'


PROFILE_TEXT = "[profile]\naccess = motorcar\n[class primary]\nmax_speed = 100\naverage = 80\n[class residential]\nmax_speed = 50\naverage = 60\n[node 0]\nkey = highway\nvalue = traffic_signals\nkind = fixed\namount = 7\n"
TREE = "access access\nvehicle access\nmotor_vehicle vehicle\nmotorcar motor_vehicle\n"


def test_network_of_a_small_file_in_three_formats(spark, tmp_path):
    import bz2

    from wayfold.plans import network_store
    from wayfold.sources import profiles

    (tmp_path / "m.osm").write_text(xml_text())
    (tmp_path / "m.osm.bz2").write_bytes(bz2.compress(xml_text().encode()))
    pbf_file(tmp_path / "m.pbf")
    profile, speeds = profiles.load(PROFILE_TEXT, profiles.access_tree(TREE))
    assert profile.access == ["motorcar", "motor_vehicle", "vehicle", "access"]
    assert profiles.load(profiles.save(profile, speeds), profiles.access_tree(TREE)) == (profile, speeds)
    found = []
    for name in ("m.osm", "m.osm.bz2", "m.pbf"):
        raw = [readers.osm(spark, str(tmp_path / name), e) for e in ("node", "way", "relation")]
        network_store.write(network_store.build(*raw, profile, speeds), str(tmp_path / f"{name}-net"))
        net = network_store.read(spark, str(tmp_path / f"{name}-net"))
        ids = {r.node: r.id for r in net["nodes"].collect()}
        edges = sorted((r.way, ids[r.source], ids[r.target], r.oneway, round(r.metres), round(r.seconds, 2), len(r.path)) for r in net["edges"].collect())
        found.append((edges, [tuple(r) for r in net["places"].select("name", "place").collect()], net["restrictions"].count()))
        assert network_store.graph(net["edges"]).count() == sum(1 if e[3] else 2 for e in edges)
    assert found[0] == found[1] == found[2]
    edges, places, restrictions = found[0]
    assert places == [("Alt", "Town")] and restrictions == 1
    # Way 10 is cut at node 2 (used thrice) and at the gate, which ends it in two nodes of its own; 11 runs against its nodes.
    ends = [e[1:3] for e in edges]
    assert [e[0] for e in edges].count(10) == 3 and (1, 2) in ends and (5, 2) in ends and (4, 5) in ends
    gate = sorted(i for e in edges if e[0] == 10 for i in e[1:3] if i < 0)
    assert len(gate) == 2 and 3 not in {i for e in ends for i in e}
    first = next(e for e in edges if e[:3] == (10, 1, 2))
    assert abs(first[5] - (111.2 * 3.6 / (48.28032 * 0.8) + 7)) < 0.1 and not first[3]
    pbf_file(tmp_path / "odd.pbf", (b"HistoricalInformation",))
    with pytest.raises(ValueError, match="HistoricalInformation"):
        readers.osm(spark, str(tmp_path / "odd.pbf"), "node")


def test_vincenty_known_distance(spark):
    rows = spark.createDataFrame([(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (1.0, 2.0, 1.0, 2.0)], "a double, b double, c double, d double")
    found = [r[0] for r in rows.select(geo.vincenty_m(*[F.col(c) for c in "abcd"])).collect()]
    assert abs(found[0] - 54972.271) < 0.01 and found[1] == 0.0


def test_large_graphs_take_rounds_of_joins(spark, monkeypatch):
    edges = [(0, 1, 4), (1, 2, 1), (0, 2, 9), (2, 0, 3), (3, 0, 1)]
    graph = spark.createDataFrame(edges, "source long, target long, cost long")
    origins = spark.createDataFrame([(0,), (3,)], "origin long")
    sent = sorted(tuple(r) for r in routing.all_distances(graph, origins).collect())
    monkeypatch.setattr(routing, "SENT_EDGES", 0)
    assert sorted(tuple(r) for r in routing.all_distances(graph, origins).collect()) == sent
    assert [r for r in sent if r[:2] == (0, 2)] == [(0, 2, 5, 1)]


def test_gpx_is_read_back(spark, tmp_path):
    rows = [(1, 0, 1, 2.0, 3.0, None, 5), (1, 0, 0, 1.0, 2.0, 9.0, 4), (1, 1, 0, 7.0, 8.0, 1.0, 6)]
    track = spark.createDataFrame(rows, "track long, segment int, pos int, lat double, lon double, ele double, s long").withColumn("time", F.timestamp_seconds("s"))
    readers.write_gpx(track, str(tmp_path / "g"))
    found = readers.gpx(spark, str(tmp_path / "g")).orderBy("segment", "pos").collect()
    assert [(r.segment, r.pos, r.lat, r.ele) for r in found] == [(0, 0, 1.0, 9.0), (0, 1, 2.0, None), (1, 0, 7.0, 1.0)]


def test_stream_state_and_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"class":"TPV","device":"a","mode":%d,"time":"2024-01-01T00:00:%02dZ","lat":%s,"lon":2.0,"alt":5.0,"speed":%s}'
    latest = gps.stream_latest(gps.reports(spark.readStream.text(str(tmp_path / "in"))))
    q = latest.writeStream.outputMode("append").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).start()
    log = gps.follow(gps.reports(spark.readStream.text(str(tmp_path / "in"))), lambda b: b.select("device", "lat"), str(tmp_path / "log"), str(tmp_path / "c2"), 1).start()
    for k, text in enumerate([line % (3, 1, "1.0", "4.0"), line % (2, 2, "1.5", "null")]):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
        q.processAllAvailable()
        log.processAllAvailable()
    q.stop()
    log.stop()
    found = spark.table("latest").orderBy("ts").collect()
    assert [(r.lat, r.alt, r.speed) for r in found] == [(1.0, 5.0, 4.0), (1.5, 5.0, 4.0)]
    assert sorted(r.lat for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1.0, 1.5]
