"""Polylines of streets: every edge once, neighbours meet, as few open pieces as can be."""

import collections

import numpy as np
import pytest

from wayfold.operators import chains

SCHEMA = "place long, street string, edge long, source long, target long, reversible boolean, piece string"


def random_streets(seed):
    rng, rows = np.random.default_rng(seed), []
    for e in range(300):
        street = int(rng.integers(0, 8))
        two_way = street % 4 == 0 or rng.random() < [0, 1, 0.5, 0][street % 4]
        rows.append((1 if street < 4 else None, f"s{street}", e, int(rng.integers(0, 12)), int(rng.integers(0, 12)), bool(two_way), "x"))
    rows += [(2, "long", 1000 + i, *((1000 + i, 1001 + i) if i % 3 else (1001 + i, 1000 + i)), True, "x") for i in range(700)]
    rows += [(3, "ring", 3000 + i, i, (i + 1) % 7, False, "x") for i in range(7)] + [(3, "loop", 3100, 5, 5, True, "x"), (3, None, 3101, 5, 6, False, "x")]
    return rows


@pytest.mark.parametrize("seed", [0, 2])
def test_pieces_by_brute_force(spark, seed):
    rows = random_streets(seed)
    found = chains.chains(spark.createDataFrame(rows, SCHEMA), ["place", "street"]).collect()
    known = {r[2]: r for r in rows}
    assert sorted(r.edge for r in found) == sorted(known)
    pieces = collections.defaultdict(list)
    for r in found:
        assert (r.place, r.street) == known[r.edge][:2] and (known[r.edge][5] or not r.reversed)
        pieces[r.place, r.street, r.piece].append(r)
    open_ = collections.Counter()
    for (*street, piece), own in pieces.items():
        own.sort(key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and own[0].edge == piece
        ends = [known[r.edge][3:5] if not r.reversed else known[r.edge][4:2:-1] for r in own]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        open_[tuple(street)] += ends[0][0] != ends[-1][1]
    for street in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == street]
        if all(r[5] for r in own):
            degree = collections.Counter(x for r in own for x in r[3:5])
            assert open_[street] == sum(n % 2 for n in degree.values()) / 2, street
    assert len({r.piece for r in found if r.street == "long"}) == len({r.piece for r in found if r.street == "ring"}) == 1


def test_one_way_edges_keep_their_direction(spark):
    rows = [(1, "a", 1, 1, 2, False, ""), (1, "a", 2, 3, 2, True, ""), (1, "a", 3, 3, 4, False, ""), (1, "a", 4, 5, 4, False, "")]
    found = {r.edge: (r.piece, r.pos, r.reversed) for r in chains.chains(spark.createDataFrame(rows, SCHEMA), ["place", "street"]).collect()}
    assert found == {1: (1, 0, False), 2: (1, 1, True), 3: (1, 2, False), 4: (4, 0, False)}
    assert chains.chains(spark.createDataFrame([], SCHEMA), ["place", "street"]).count() == 0
