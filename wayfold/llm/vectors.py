"""What the vector operators share: whole integer vectors, packed by the thousand into rows of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import common

#: Vectors that are packed into one row, and the bytes that such a row has at most (but for a single longer vector).
CHUNK, CHUNK_BYTES = 1024, 1 << 20
#: Components must stay under this, so that sums of products are exact.
FAR = 1 << 29


def integers(embeddings: DataFrame, factor: int) -> DataFrame:
    """row, vec_id, label, v: v is floor(factor * x) of each component x, as integers; stored, with a number for each row.

    Rows whose vector is null or holds null or non-finite components are left out, and so are those of another length than
    most vectors have (of equally many the longer). Other columns are ignored. Repeated rows are rows of their own.
    """
    rows = common.only(embeddings, "vec_id", "label", "embedding").where("embedding is not null")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("embedding", odd))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("embedding") == (usual[0]["d"] if usual else 0))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return common.stash(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v")), "vectors")


def matrix(v: pa.Array, d: int) -> np.ndarray:
    """Rows of integers; raises where one is too large for exact sums."""
    flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(flat.max(), -flat.min()) >= FAR:
        raise ArithmeticError(f"a component's integer is {FAR} or more, beyond exact sums")
    return flat.reshape(len(v), d)


CHUNKS = "chunk long, n int, d int, top double, row binary, vec_id binary, has_id binary, label binary, has_label binary, v binary"


def pack(rows: DataFrame) -> DataFrame:
    """rows (row, vec_id, label, v, in whatever order the partitions have) as rows of up to CHUNK vectors each (CHUNKS): v
    as little-endian 32-bit integers, ids and labels as 64-bit integers with flags for nulls, top the largest norm."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            d = len(b.column("v")[0])
            step = max(1, min(CHUNK, CHUNK_BYTES // max(1, 4 * d)))
            for at in range(0, b.num_rows, step):
                c = b.slice(at, step)
                v = matrix(c.column("v"), d)
                plain = lambda name: c.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                known = lambda name: (~c.column(name).is_null().to_numpy(zero_copy_only=False)).tobytes()
                norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max()) * (1 + 1e-12)) if len(v) else 0.0
                found = [(part << 32) + k, len(v), d, norm, plain("row"), plain("vec_id"), known("vec_id"), plain("label"), known("label"), v.astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, [pa.int64(), pa.int32(), pa.int32(), pa.float64()] + [pa.binary()] * 6)], names=NAMES)
                k += 1

    NAMES = [x.split()[0] for x in CHUNKS.split(", ")]
    common.batch_rows(rows.sparkSession, 4 * CHUNK)
    return rows.select("row", "vec_id", F.col("label").cast("long").alias("label"), "v").mapInArrow(work, CHUNKS)


def unpack(blob: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4").reshape(n, d)


def longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def flags(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.bool_)


def norm(v: Column) -> Column:
    """Length of an integer vector as a double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
