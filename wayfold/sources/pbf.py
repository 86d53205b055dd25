"""Binary map extracts, read by ranges of bytes: each task finds the first header in its range and decodes a blob at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Features that a file may require; limits of the format on headers and blobs.
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
#: How the header of a data blob begins, after four bytes with its length; bytes searched for it at a time; bytes of a task.
MARK, STEP, RANGE = b"\x0a\x07OSMData", 1 << 20, 64 << 20
_TAGS = "tags array<struct<k: string, v: string>>"
SCHEMAS = {
    "node": f"id long, lat double, lon double, {_TAGS}",
    "way": f"id long, nodes array<long>, {_TAGS}",
    "relation": f"id long, members array<struct<type: string, ref: long, role: string>>, {_TAGS}",
}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: integers, or the bytes of a part."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def numbers(parts: list[bytes], signed: bool = False, running: bool = False) -> list[int]:
    """Packed integers, zigzag coded if signed, summed up if they are differences."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if not len(data):
        return []
    ends = np.flatnonzero(data < 128)
    if not len(ends) or ends[-1] != len(data) - 1:
        raise ValueError("packed integers that end within one")
    starts = np.concatenate([[0], ends[:-1] + 1])
    shifts = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64)
    values = np.bitwise_or.reduceat((data & 127).astype(np.uint64) << shifts, starts)
    if signed:
        values = (values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))
    return (np.cumsum(values.view(np.int64)) if running else values.view(np.int64)).tolist()


def opened(path: str) -> pa.NativeFile:
    """A file to be read at any place: of this machine, or by a URL of a file system that Arrow knows."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def header(file: pa.NativeFile, at: int) -> tuple[str, int, int]:
    """kind, offset and length of the blob whose header begins at a place."""
    file.seek(at)
    n = struct.unpack(">I", file.read(4))[0]
    if n > MOST_HEADER:
        raise ValueError(f"a header of {n} bytes")
    own = message(file.read(n))
    if own[3][0] > MOST_BLOB:
        raise ValueError(f"a blob of {own[3][0]} bytes")
    return own[1][0].decode(), at + 4 + n, own[3][0]


def is_header(file: pa.NativeFile, at: int, size: int) -> bool:
    """Whether a data blob's header begins there, after whose blob the file ends or another header begins."""
    try:
        kind, offset, length = header(file, at)
        end = offset + length
        return kind == "OSMData" and (end == size or (end < size and bool(header(file, end))))
    except (AttributeError, IndexError, KeyError, TypeError, ValueError, struct.error):
        return False


def first_header(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the first header of a data blob begins at or after start; the file's size if there is none."""
    for base in range(start, size, STEP):
        file.seek(base)
        window = file.read(STEP + 4 + len(MARK))
        at = window.find(MARK, 4)
        while at >= 0:
            if is_header(file, base + at - 4, size):
                return base + at - 4
            at = window.find(MARK, at + 1)
    return size


def blob(file: pa.NativeFile, offset: int, length: int) -> bytes:
    file.seek(offset)
    own = message(file.read(length))
    return own[1][0] if 1 in own else zlib.decompress(own[3][0])


def blocks(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The data blocks whose headers begin within a range of bytes.

    Headers lead from one to the next up to the first data blob beyond the range. The search from `stop`, with which the
    next range begins, has to find that same one, else this raises: so no block is lost or read twice."""
    size = file.size()
    at = first_header(file, start, size) if start else 0
    found = at < stop
    while at < size:
        kind, offset, length = header(file, at)
        if offset + length > size:
            raise ValueError(f"the file ends within the blob at byte {offset}")
        if kind == "OSMData":
            if at >= stop:
                break
            yield blob(file, offset, length)
        elif kind == "OSMHeader":
            check_features(blob(file, offset, length))
        at = offset + length
    if found and at != (follower := first_header(file, stop, size) if stop < size else size):
        raise ValueError(f"headers lead to byte {at}, a search to {follower}")


def check_features(header: bytes) -> None:
    """Raise if the file needs what this reader doesn't have."""
    lacking = {x.decode() for x in message(header).get(4, [])} - FEATURES
    if lacking:
        raise ValueError(f"required features that aren't supported: {', '.join(sorted(lacking))}")


def entities(data: bytes, entity: str, keys: set[str] | None) -> Iterator[dict]:
    """The nodes, ways or relations of a block, in its order; with keys, only tags of these are kept."""
    block = message(data)
    text = [x.decode("utf-8", "replace") for x in message(block[1][0]).get(1, [])]
    grain, lat0, lon0 = block.get(17, [100])[0], _signed(block.get(19, [0])[0]), _signed(block.get(20, [0])[0])
    degrees = lambda v, base: (base + grain * v) / 1e9
    tags = lambda ks, vs: [{"k": text[k], "v": text[v]} for k, v in zip(ks, vs) if keys is None or text[k] in keys]
    for group in map(message, block.get(2, [])):
        if entity == "node":
            for own in map(message, group.get(1, [])):
                zig = lambda v: (v >> 1) ^ -(v & 1)
                yield {"id": zig(own[1][0]), "lat": degrees(zig(own[8][0]), lat0), "lon": degrees(zig(own[9][0]), lon0), "tags": tags(numbers(own.get(2, [])), numbers(own.get(3, [])))}
            for own in map(message, group.get(2, [])):
                pairs, at = numbers(own.get(10, [])), 0
                for i, y, x in zip(*(numbers(own.get(k, []), True, True) for k in (1, 8, 9))):
                    ks, vs = [], []
                    while at < len(pairs) and pairs[at]:
                        ks.append(pairs[at])
                        vs.append(pairs[at + 1])
                        at += 2
                    at += 1
                    yield {"id": i, "lat": degrees(y, lat0), "lon": degrees(x, lon0), "tags": tags(ks, vs)}
        elif entity == "way":
            for own in map(message, group.get(3, [])):
                yield {"id": own[1][0], "nodes": numbers(own.get(8, []), True, True), "tags": tags(numbers(own.get(2, [])), numbers(own.get(3, [])))}
        else:
            for own in map(message, group.get(4, [])):
                rows = zip(numbers(own.get(10, [])), numbers(own.get(9, []), True, True), numbers(own.get(8, [])))
                members = [{"type": ("node", "way", "relation")[kind], "ref": ref, "role": text[role]} for kind, ref, role in rows]
                yield {"id": own[1][0], "members": members, "tags": tags(numbers(own.get(2, [])), numbers(own.get(3, [])))}


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def osm_pbf(spark: SparkSession, path: str, entity: str, keys: list[str] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Nodes, ways or relations of a file that the driver and all executors can open, by path or URL.

    The driver reads the first header alone; tasks read ranges of bytes. Raises where the file needs unknown features or
    isn't whole. An empty file has no rows."""
    with opened(path) as file:
        size = file.size()
        if size:
            kind, offset, length = header(file, 0)
            if kind == "OSMHeader":
                check_features(blob(file, offset, length))
    kept = set(keys) if keys is not None else None
    kinds = to_arrow_schema(StructType.fromDDL(SCHEMAS[entity]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as file:
            for b in batches:
                for k in b.column("id").to_pylist():
                    for block in blocks(file, k * range_bytes, (k + 1) * range_bytes):
                        yield pa.RecordBatch.from_pylist(list(entities(block, entity, kept)), schema=kinds)

    ranges = -(-size // range_bytes)
    return spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInArrow(decode, SCHEMAS[entity])
