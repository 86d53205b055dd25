"""Binary map extracts read by ranges of bytes, and packed integers, against plain versions."""

import random
import struct
import zlib

import pytest
from test_road import packed, pb

from wayfold.sources import pbf


def blob_bytes(kind, body, raw=False):
    blob = pb(1, body) if raw else pb(2, len(body)) + pb(3, zlib.compress(body))
    head = pb(1, kind) + pb(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def block_of(nodes, text=b"x"):
    """A block of dense nodes (id, lat, lon in units of 1e-7 degrees), each with the tag x=text."""
    dense = pb(1, packed([n[0] for n in nodes], True, True)) + pb(8, packed([n[1] for n in nodes], True, True)) + pb(9, packed([n[2] for n in nodes], True, True)) + pb(10, packed([1, 2, 0] * len(nodes)))
    return pb(1, pb(1, b"") + pb(1, b"x") + pb(1, text)) + pb(2, pb(2, dense))


def some_nodes(draw, n):
    return [(draw.randrange(-(2**50), 2**50), draw.randrange(-9 * 10**8, 9 * 10**8), draw.randrange(-18 * 10**8, 18 * 10**8)) for _ in range(n)]


@pytest.mark.parametrize("signed", [False, True])
def test_packed_integers(signed):
    draw = random.Random(3)
    values = [draw.randrange(0, 2**k) * (draw.choice([1, -1]) if signed else 1) for k in range(1, 63) for _ in range(20)]
    assert pbf.numbers([packed(values, signed)], signed) == values
    steps = [v % 10**9 for v in values]
    data = packed(steps, True, True)
    assert pbf.numbers([data], True, True) == steps and pbf.numbers([]) == pbf.numbers([b""]) == []
    with pytest.raises(ValueError, match="within one"):
        pbf.numbers([b"\x05\x85"])


def test_any_ranges_give_the_rows_once(spark, tmp_path):
    """Blobs of unlike sizes; one is stored as it is and holds the bytes with which headers begin, whole header and all."""
    draw = random.Random(4)
    blocks = [some_nodes(draw, n) for n in (1, 300, 2, 40, 1000, 5)]
    bait = blob_bytes(b"OSMData", b"")[:-8] + pbf.MARK + b"\x18\x05 and on"
    head = blob_bytes(b"OSMHeader", pb(4, b"DenseNodes"), True)
    parts = [head, *(blob_bytes(b"OSMData", block_of(b, bait), k == 3) for k, b in enumerate(blocks)), blob_bytes(b"Other", b"abc"), head]
    parts.insert(4, blob_bytes(b"Other", b"abc"))
    (tmp_path / "m.pbf").write_bytes(b"".join(parts))
    want = sorted((i, round(y / 1e7, 7), round(x / 1e7, 7)) for b in blocks for i, y, x in b)
    size = len(b"".join(parts))
    for path, step in ((str(tmp_path / "m.pbf"), size + 1), (f"file://{tmp_path}/m.pbf", 1000), (str(tmp_path / "m.pbf"), 257)):
        found = pbf.osm_pbf(spark, path, "node", range_bytes=step).collect()
        assert sorted((r.id, round(r.lat, 7), round(r.lon, 7)) for r in found) == want
    with pbf.opened(str(tmp_path / "m.pbf")) as file:
        starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
        data = [s for s, part in zip(starts, parts) if part[4:13] == pbf.MARK]
        for at in range(0, size, 7):
            assert pbf.first_header(file, at, size) == min([s for s in data if s >= at], default=size)
        for step in (64, 999):
            own = [b for k in range(-(-size // step)) for b in pbf.blocks(file, k * step, (k + 1) * step)]
            assert own == [block_of(b, bait) for b in blocks]


def test_damage_is_told(spark, tmp_path):
    """A file cut within a blob, a blob passed over by the search since its header's fields are turned round, no file's content."""
    nodes = some_nodes(random.Random(5), 200)
    whole = blob_bytes(b"OSMHeader", pb(4, b"DenseNodes"), True) + blob_bytes(b"OSMData", block_of(nodes))
    (tmp_path / "cut.pbf").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends within the blob"):
        pbf.osm_pbf(spark, str(tmp_path / "cut.pbf"), "node").collect()
    blob = pb(1, block_of(nodes))
    turned = pb(3, len(blob)) + pb(1, b"OSMData")
    (tmp_path / "turned.pbf").write_bytes(whole + struct.pack(">I", len(turned)) + turned + blob)
    assert pbf.osm_pbf(spark, str(tmp_path / "turned.pbf"), "node").count() == 400
    with pytest.raises(Exception, match="a search to"):
        pbf.osm_pbf(spark, str(tmp_path / "turned.pbf"), "node", range_bytes=len(whole) - 5).collect()
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert pbf.osm_pbf(spark, str(tmp_path / "empty.pbf"), "way").count() == 0
