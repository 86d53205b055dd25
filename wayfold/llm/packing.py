"""Best-two-fit packing of token sequences.

Pieces are dealt out at random (by a hash of document and piece) to shards of about `shard_pieces` pieces, each packed
by one task on its own: a shard leaves at most one poorly filled sequence, so the loss against packing all at once is
about one sequence in thousands, and the work is linear in the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import common, tokens
from wayfold.llm.common import INT, LONG, schema

END = 0
ROOM = 2048


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Each bin is filled with the longest piece that fits, until none does; then, if two
    unpacked pieces fill the gap that its shortest piece would leave more tightly than that piece, they replace it."""
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(waiting)
    bins, starts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size: int) -> int:
        found = waiting[size]
        i = found.pop()
        if not found:
            del waiting[size]
            sizes.pop(bisect_right(sizes, size) - 1)
        return i

    def give_back(size: int, i: int) -> None:
        if size not in waiting:
            waiting[size] = []
            sizes.insert(bisect_right(sizes, size), size)
        waiting[size].append(i)

    def fill(own: list[tuple[int, int]], gap: int) -> int:
        while sizes and (k := bisect_right(sizes, gap)):
            own.append((sizes[k - 1], take(sizes[k - 1])))
            gap -= own[-1][0]
        return gap

    def two(gap: int, more_than: int) -> tuple[int, int] | None:
        """The two unpacked pieces of the largest sum within gap, if that is over more_than."""
        best, pair = more_than, None
        low, high = 0, bisect_right(sizes, gap) - 1
        while 0 <= low <= high and best < gap:
            a, b = sizes[low], sizes[high]
            if a + b > gap:
                high -= 1
            elif low == high and len(waiting[a]) < 2:
                break
            else:
                if a + b > best:
                    best, pair = a + b, (a, b)
                if low == high:
                    break
                low += 1
        if pair is None or pair[0] != pair[1]:
            for a in sizes[: bisect_right(sizes, gap // 2)]:  # two of one length
                if len(waiting[a]) > 1 and best < 2 * a <= gap:
                    best, pair = 2 * a, (a, a)
        return pair

    n = 0
    while sizes:
        own: list[tuple[int, int]] = []
        gap = fill(own, room)
        if gap and len(own) > 1:
            size, i = own[-1]
            if pair := two(gap + size, size):
                own.pop()
                own += [(s, take(s)) for s in pair]
                give_back(size, i)
                fill(own, gap + size - sum(pair))
        at = 0
        for size, i in own:
            bins[i], starts[i] = n, at
            at += size
        n += 1
    return bins, starts


PIECES = T.StructType(
    [
        *schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG).fields,
        T.StructField("ids", T.ArrayType(T.IntegerType(), True)),
    ]
)


def pieces(documents: DataFrame, path: str, room: int = ROOM, keep_ids: bool = True) -> DataFrame:
    """The token pieces of every document: its ids and END, cut into runs of `room` ids where it is longer.

    A null text is empty (END alone). Repeated rows each give their own pieces. With keep_ids false, ids is null.
    """
    docs = common.only(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end = np.array([END], dtype="<u4").tobytes()
        for b in tokens.chunks(batches):
            rows, kept = [], []
            for doc_id, found in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text"))):
                found += end
                for k, i in enumerate(range(0, len(found), 4 * room)):
                    own = found[i : i + 4 * room]
                    rows.append((doc_id, k, i // 4, len(own) // 4, zlib.crc32(own)))
                    kept.append(np.frombuffer(own, dtype="<i4") if keep_ids else None)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int32()))], names=PIECES.names)

    return docs.mapInArrow(cut, PIECES)


def pack(found: DataFrame, room: int = ROOM, shard_pieces: int = 6000) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces of full length are sequences of their own and are not shuffled."""
    full = found.where(F.col("length") >= room).select(
        *found.columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    short = found.where(F.col("length") < room)
    shards = max(1, round(short.count() / shard_pieces))
    kept = [c for c in found.columns]
    out = T.StructType([*found.schema.fields, T.StructField("sequence_id", LONG), T.StructField("offset", LONG)])

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, starts = best_two_fit(table.column("length").to_numpy(), room)
        ids = (np.int64(key[0].as_py()) << np.int64(32)) + bins
        return table.select(kept).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(starts))

    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(place, out).unionByName(full)


def pack_documents(documents: DataFrame, path: str, room: int = ROOM, keep_ids: bool = True, shard_pieces: int = 6000) -> DataFrame:
    """Pack all documents into sequences of at most `room` tokens: one row per piece with its sequence and place.

    Ties in length go by doc_id and piece. An empty table gives no rows; extra columns are ignored.
    """
    common.batch_rows(documents.sparkSession, 1000)
    found = common.stash(pieces(documents, path, room, keep_ids).drop(*[] if keep_ids else ["ids"]), "pieces")
    return pack(found, room, shard_pieces)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, at most `room` ids each, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
