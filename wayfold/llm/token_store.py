"""Token ids in ORC: ids of each document as one array, integer run-length encoded, with row indexes and a Bloom filter
on the document id, in ascending order of it over files and rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wayfold.llm import common, tokens
from wayfold.llm.common import INT, LONG, schema

END = 0

STORED = T.StructType(
    [
        *schema(part=INT, seq=LONG, doc_id=LONG, n_tokens=LONG).fields,
        T.StructField("ids", T.ArrayType(T.IntegerType(), True)),
    ]
)


def encode_documents(documents: DataFrame, path: str, rows_per_part: int = 4000) -> DataFrame:
    """(part, seq, doc_id, n_tokens, ids): parts are ascending ranges of doc_id, seq is the place in one; ids end with
    END.

    A null text is empty: its ids are END alone. A null doc_id comes first. Repeated doc_ids are kept, each with its
    own row, in order of their texts. An empty table gives no rows; extra columns are ignored.
    """
    docs = common.only(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end, seq = np.array([END], dtype="<u4").tobytes(), 0
        for b in tokens.chunks(batches):
            found = [x + end for x in encoder.encode(b.column("text"))]
            n = np.array([len(x) // 4 for x in found], dtype=np.int64)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                pa.array(np.frombuffer(b"".join(found), dtype="<i4")),
            )
            places = pa.array(np.arange(seq, seq + len(n)))
            seq += len(n)
            yield pa.RecordBatch.from_arrays([b.column("part"), places, b.column("doc_id"), pa.array(n), ids], names=STORED.names)

    return common.in_order(docs, rows_per_part, "text").mapInArrow(encode, STORED)


def write_orc(encoded: DataFrame, target: str, stripe_mb: int = 16, index_rows: int = 1000) -> None:
    """Write encoded documents to ORC files at target; bounds on stripes and row-index strides are parameters."""
    (
        encoded.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(target)
    )


def read_orc(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored documents, or those of doc_ids: that filter reaches the stripes' statistics and Bloom filters."""
    stored = spark.read.schema(STORED).orc(target)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def token_index(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each stored document."""
    out = schema(part=INT, seq=LONG, doc_id=LONG, n_tokens=LONG, ids_crc32=LONG)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0)), dtype=np.int64)
            starts = ends - np.asarray(ids.value_lengths().fill_null(0))
            sums = [zlib.crc32(flat[i:j].data) if j > i else 0 for i, j in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in out.names[:-1]), pa.array(sums, pa.int64())], names=out.names
            )

    digests = stored.mapInArrow(digest, out)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = common.offsets(sizes, ["part"], "part_tokens", "part_start").select("part", "part_start")
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return (
        digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before, "part")
        .select("doc_id", (F.col("part_start") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def encode_to_orc(documents: DataFrame, path: str, target: str) -> DataFrame:
    """Encode every text, write the ids to ORC at target, and return them as read back."""
    common.batch_rows(documents.sparkSession, 1000)
    write_orc(encode_documents(documents, path), target)
    return read_orc(documents.sparkSession, target)
