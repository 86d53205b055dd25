"""One job from map data to a network with city speeds, curves, turns, addresses and counters."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators.turns import Driving
from wayfold.plans import network_store
from wayfold.sources import profiles

PROFILE = """[profile]
access = motorcar
[class primary]
priority = 2
max_speed = 100
city_speed = 50
average = 80
[class residential]
priority = 1
max_speed = 50
city_speed = 30
average = 60
left_penalty = 5
yields_left = yes
[node 0]
key = highway
value = traffic_signals
kind = fixed
amount = 7
"""
# A village at 13.0 (1 km around it counts) and a town with a square outline from 13.3 to 13.4; the same ways in and between them.
NODES = {1: (52.0, 13.001), 2: (52.0, 13.002), 3: (52.001, 13.002), 11: (52.0, 13.2), 12: (52.0, 13.201), 13: (52.001, 13.201), 14: (52.0, 13.203), 21: (52.0, 13.35), 22: (52.0, 13.351)}
SQUARE = {31: (51.9, 13.3), 32: (51.9, 13.4), 33: (52.1, 13.4), 34: (52.1, 13.3)}
WAYS = [
    (100, [1, 2], {"highway": "residential", "name": "Village  Street"}), (101, [2, 3], {"highway": "residential", "maxspeed": "40"}), (102, [11, 12, 13], {"highway": "residential", "name": "Bend"}),
    (103, [21, 22], {"highway": "primary", "name": "Town Road"}), (104, [12, 14], {"highway": "primary"}), (105, [31, 32, 33, 34, 31], {"place": "town", "place_name": "Stadt"}), (106, [1, 999], {"highway": "primary"}),
]


@pytest.fixture(scope="module")
def imported(spark):
    tag = "array<struct<k: string, v: string>>"
    tags = lambda t: list(t.items())
    nodes = [(i, *p, []) for i, p in {**NODES, **SQUARE}.items()] + [(50, 52.0, 13.0, tags({"place": "village", "name": "Dorf"})), (51, 52.0, 13.38, tags({"place": "town", "name": "Stadt"}))]
    members = [("way", 102, "from"), ("node", 12, "via"), ("way", 104, "to")]
    relations = [(900, members, tags({"type": "restriction", "restriction": "no_right_turn"})), (901, [], tags({"type": "route"}))]
    raw = [
        spark.createDataFrame(nodes, f"id long, lat double, lon double, tags {tag}"), spark.createDataFrame([(i, n, tags(t)) for i, n, t in WAYS], f"id long, nodes array<long>, tags {tag}"),
        spark.createDataFrame(relations, f"id long, members array<struct<type: string, ref: long, role: string>>, tags {tag}"),
    ]
    profile, speeds = profiles.load(PROFILE, [("access", "access"), ("motorcar", "access")])
    counters = network_store.Counters()
    return network_store.build(*raw, profile, speeds, Driving(), counters), counters


def metres(a, b):
    """On the ellipsoid, for short distances, by its two radii of curvature."""
    lat = math.radians((a[0] + b[0]) / 2)
    w = 1 - 0.00669437999014 * math.sin(lat) ** 2
    return math.hypot(math.radians(b[0] - a[0]) * 6378137 * (1 - 0.00669437999014) / w**1.5, math.radians(b[1] - a[1]) * 6378137 / w**0.5 * math.cos(lat))


def test_speeds_by_place_tag_and_curve(imported):
    tables, _ = imported
    ids = {r.node: r.id for r in tables["nodes"].collect()}
    edges = {(r.way, ids[r.source], ids[r.target]): r for r in tables["edges"].collect()}
    assert set(edges) == {(100, 1, 2), (101, 2, 3), (102, 11, 12), (102, 12, 13), (103, 21, 22), (104, 12, 14)}
    for (way, a, b), kmh in {(100, 1, 2): 30 * 0.6, (101, 2, 3): 40 * 0.6, (102, 11, 12): 50 * 0.6, (103, 21, 22): 50 * 0.8, (104, 12, 14): 100 * 0.8}.items():
        long = metres(NODES[a], NODES[b])
        assert abs(edges[way, a, b].metres - long) < 0.01
        assert abs(edges[way, a, b].seconds - long * 3.6 / kmh) < 0.02, way


def test_turns_addresses_places(imported):
    tables, _ = imported
    ids = {r.id: r.node for r in tables["nodes"].collect()}
    turns = [(r.from_way, r.to_way) for r in tables["turns"].where(F.col("node") == ids[12]).collect()]
    # Three ends, two of way 102, meet at node 12: nine turns, of which way 102 onto 104 is forbidden from both its edges.
    assert len(turns) == 7 and (102, 104) not in turns and tables["restrictions"].count() == 1
    way = {r.edge: r.way for r in tables["edges"].collect()}
    lived = sorted((way[r.edge], r.place, r["name"]) for r in tables["addresses"].collect())
    assert lived == [(100, 50, "Village Street"), (103, 51, "Town Road")]
    assert {r["name"]: (r.place, r.outlined) for r in tables["places"].collect()} == {"Dorf": ("Village", False), "Stadt": ("Town", True)}


def test_counters_equal_separate_aggregates(imported):
    tables, counters = imported
    found = counters.result()
    assert len(found) == 20
    turns = tables["turns"].toPandas()
    left, right = (turns.angle < 0) & (turns.angle > -135), (turns.angle > 0) & (turns.angle < 135)
    wanted = {
        "nodes": 15, "ways": 7, "relations": 2, "restrictions": 1, "places": 2, "outlines": 1, "used_nodes": 9, "segments": 6, "edges": 6, "max_speeds": 1, "zero_speeds": 0,
        "default_city_speeds": 2, "city_edges": 3, "addresses": 2, "restrictions_applied": 2, "turns": len(turns), "max_turn": turns.seconds.max(), "mean_left": turns.seconds[left].mean(),
        "mean_right": turns.seconds[right].mean(), "mean_straight": turns.seconds[~(left | right)].mean(),
    }
    for name, value in wanted.items():
        assert found[name] == pytest.approx(value), name


def test_stored_network_is_read_back(spark, imported, tmp_path):
    tables, _ = imported
    network_store.write(tables, str(tmp_path))
    back = network_store.read(spark, str(tmp_path))
    assert {n: t.count() for n, t in back.items()} == {n: t.count() for n, t in tables.items()}
    assert network_store.graph(back["edges"]).count() == 12
