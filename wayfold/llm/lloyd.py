"""Product codes of vectors by delta-maintained Lloyd rounds in exact integers.

Vectors are packed into chunks and stored in buckets by chunk. The assignments of a round are a table of their own, in the
same buckets, so that reading vectors with their last assignments moves nothing. A round sends only what changed: for each
part whose entry is another than before, its components with a plus to the new entry and a minus to the old one, summed
within the task. The running sums are a fixed number of integers: entries x components.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import common, vectors


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """df stored in the shared folder in buckets by chunk, to be joined with its like without an exchange."""
    spark = df.sparkSession
    path, table = common.stash_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, "chunk").write.bucketBy(parts, "chunk").sortBy("chunk").option("path", path).saveAsTable(table)
    found = spark.table(table)
    found._stashed, found._table = path, table
    return found


def _drop(*tables: DataFrame | None) -> None:
    for t in tables:
        if t is not None:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
            common.drop(t)


def nearest(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each vector: the nearest entry, of equally near ones the lower. Exact."""
    n, width = len(v), v.shape[1] // len(books) if books else 0
    codes, far = np.empty((n, len(books)), np.uint8), np.empty((n, len(books)), np.int64)
    for p, book in enumerate(books):
        x = v[:, p * width : (p + 1) * width].astype(np.int64)
        d = np.stack([((x - e) ** 2).sum(1) for e in book.astype(np.int64)], axis=1)
        codes[:, p] = d.argmin(1)
        far[:, p] = d.min(1)
    return codes, far


def _books(entries: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(entries, parts, axis=1) if parts else []


def changes(v: np.ndarray, codes: np.ndarray, before: np.ndarray | None, sums: dict[tuple[int, int], np.ndarray]) -> int:
    """Add to sums[part, entry] (count, then sums of components) what the new codes change; gives the number of changed parts."""
    n, parts = codes.shape
    width, changed = v.shape[1] // parts if parts else 0, 0
    for p in range(parts):
        at = np.arange(n) if before is None else np.flatnonzero(codes[:, p] != before[:, p])
        changed += len(at)
        x = np.c_[np.ones(len(at), np.int64), v[at, p * width : (p + 1) * width].astype(np.int64)]
        for sign, own in ((1, codes[at, p]), *(() if before is None else ((-1, before[at, p]),))):
            for e in np.unique(own):
                sums[p, int(e)] = sums.get((p, int(e)), 0) + sign * x[own == e].sum(0)
    return changed


def codes_of(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that takes part (see vectors.integers).

    Vectors of floor(factor * x) are cut into `parts` equal parts (ValueError if they can't be). The codebook of each part
    starts as that part of the vectors of the `entries` (256 at most) least vec_ids, nulls last, ties by vector; every row
    counts. Each of `rounds` rounds assigns parts to entries and replaces used entries by the floor of their parts' mean; a
    round in which nothing changes is the last that matters, so later ones are not run. label_error sums over rows of one
    label, null labels together. An empty table, or one without whole vectors, gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.integers(embeddings, factor)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # at most 256 rows
    out = "vec_id long, label int, code string, error long"
    if not first:
        nothing = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    book = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), -1)
    if book.shape[1] % parts:
        raise ValueError(f"vectors of {book.shape[1]} components can't be cut into {parts} equal parts")
    width = book.shape[1] // parts
    chunks = _bucketed(vectors.pack(rows), "lloyd_vectors")
    codes, state = None, np.zeros((parts, len(book), 1 + width), np.int64)
    read = ["chunk", "n", "d", "v"]

    def assign(books: list[np.ndarray]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for n, d, v in zip(*(b.column(c).to_pylist() for c in ("n", "d", "v"))):
                    found.append(nearest(vectors.unpack(v, n, d), books)[0].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(found, pa.binary())], names=["chunk", "codes"])

        return work

    def delta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, changed = {}, 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("n", "d", "v", "codes")]
            old = b.column("before").to_pylist() if "before" in b.schema.names else [None] * len(cols[0])
            for n, d, v, new, was in zip(*cols, old):
                shaped = lambda x: None if x is None else np.frombuffer(x, np.uint8).reshape(n, parts)
                changed += changes(vectors.unpack(v, n, d), shaped(new), shaped(was), sums)
        keys = [*sums, (-1, 0)]
        values = [*(s.tolist() for s in sums.values()), [changed] + [0] * width]
        part, entry = zip(*keys)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    common.batch_rows(rows.sparkSession, 16)
    for _ in range(rounds):
        new = _bucketed(chunks.select(*read).mapInArrow(assign(_books(book, parts)), "chunk long, codes binary"), "lloyd_codes")
        both = chunks.select(*read).hint("merge").join(new, "chunk")
        if codes is not None:
            both = both.join(codes.select("chunk", F.col("codes").alias("before")).hint("merge"), "chunk")
        sent = both.mapInArrow(delta, "part int, entry int, sums array<long>")
        summed = sent.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(1 + width)])
        moved = 0
        for r in summed.collect():  # a row for each part and entry: parts x entries at most
            if r["part"] < 0:
                moved = r["s0"]
            else:
                state[r["part"], r["entry"]] += np.array([r[f"s{i}"] for i in range(1 + width)], np.int64)
        _drop(codes)
        codes = new
        if not moved:
            break
        for p in range(parts):
            used = state[p, :, 0] > 0
            book[used, p * width : (p + 1) * width] = state[p, used, 1:] // state[p, used, :1]
    _drop(codes)
    books = _books(book, parts)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, d, v, ids, has, labels, known in zip(*(b.column(c).to_pylist() for c in ("n", "d", "v", "vec_id", "has_id", "label", "has_label"))):
                code, far = nearest(vectors.unpack(v, n, d), books)
                text = [x.tobytes().hex() for x in code]
                arrays = [
                    pa.array(vectors.longs(ids), mask=~vectors.flags(has)), pa.array(vectors.longs(labels).astype(np.int32), mask=~vectors.flags(known)),
                    pa.array(text, pa.string()), pa.array(far.sum(1)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    coded = common.stash(chunks.select("n", "d", "v", "vec_id", "has_id", "label", "has_label").mapInArrow(final, out), "coded")
    _drop(chunks)
    common.drop(rows)
    keyed = coded.withColumn("__label", F.coalesce(F.col("label").cast("string"), F.lit("null")))
    totals = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(str(x) for own in books for x in own.ravel().tolist()).encode()).hexdigest()
    joined = common.join_counted(keyed, common.stash(totals, "label-errors"), ["__label"], coded.count())
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> str:
    """The same in DuckDB SQL for vectors of one length, each round spelt out; the floor of a mean in whole numbers."""
    out = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts}))::BIGINT[] AS v
    FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < {entries})"""
    for k in range(rounds + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, min(d * {entries} + e) % {entries} AS e, min(d) AS d, any_value(xv) AS v FROM
    (SELECT x.vec_id, x.label, x.p, b.e, x.v AS xv, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
     FROM x JOIN b{k} b USING (p)) GROUP BY vec_id, p)"""
        if k < rounds:
            out += f""",
c{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM
    (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(c.v, b.v) AS v FROM b{k} b LEFT JOIN c{k} c USING (p, e))"""
    return out + f""",
done AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM done"""
