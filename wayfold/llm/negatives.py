"""Hard negatives by norm-bucketed search in exact integers.

All rows are sorted by norm, longest first, and packed into buckets of up to vectors.CHUNK rows that know their largest
norm. Anchors are dealt to blocks. A bucket's scores with an anchor are at most the product of their norms, so a bucket goes
to a block only if that reaches the least score that one of the block's windows admits. In a task a block meets its buckets
longest first and drops an anchor for good once the bound is under its running k-th scores. Blocks also have stripes, each
with every so-manieth bucket, whose best rows are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.llm import common, vectors

#: Anchors in a block at most, anchors compared at a time, and groups of blocks whose bounds the driver holds.
BLOCK, STEP, GROUPS = 512, 64, 1000
LOWEST, HIGHEST = -(1 << 62), 1 << 62
NO_ID = (1 << 63) - 1  # stands for a null vec_id, which so comes last among equal scores


class Block:
    """Anchors with windows: of each window the k best rows seen so far among those it admits.

    same: candidates have the anchor's label, else another one. lo, hi (anchors x windows): scores that a window admits; a
    window with lo > hi admits none. The anchor's own row is never a candidate.
    """

    def __init__(self, rows: np.ndarray, labels: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.rows, self.labels, self.v, self.hi, self.k, self.same = rows, labels, v, hi, k, same
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        self.least = lo.copy()  # the score that a window still admits: its lower limit, or its k-th best if that is more
        self.alive = np.flatnonzero((lo <= hi).any(1))
        none = np.empty(0, np.int64)
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.none = (none, none)

    def see(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, top: float) -> None:
        open_ = np.where(self.least <= self.hi, self.least, HIGHEST)[self.alive].min(1, initial=HIGHEST)
        self.alive = self.alive[self.norm[self.alive] * top >= open_]
        if not len(self.alive):
            return
        far = float(self.norm[self.alive].max(initial=0)) * top
        kind = np.float32 if far < 1 << 24 else np.float64 if far < 1 << 53 else np.int64
        if far >= 1 << 62:
            raise ArithmeticError("inner products are beyond 64-bit integers")
        other = v.astype(kind).T
        for at in range(0, len(self.alive), STEP):
            own = self.alive[at : at + STEP]
            scores = self.v[own].astype(kind) @ other
            fits = (self.labels[own][:, None] == labels[None, :]) == self.same
            fits &= self.rows[own][:, None] != rows[None, :]
            for w in range(self.hi.shape[1]):
                good = fits & (scores >= self.least[own, w][:, None]) & (scores <= self.hi[own, w][:, None])
                for i in np.flatnonzero(good.any(1)):
                    here = np.flatnonzero(good[i])
                    self._keep(int(own[i]), w, scores[i, here].astype(np.int64), ids[here])

    def _keep(self, a: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.best.get((a, w), self.none)
        scores, ids = np.r_[old[0], scores], np.r_[old[1], ids]
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[a, w] = scores[first], ids[first]
        if len(first) == self.k:
            self.least[a, w] = max(self.least[a, w], scores[first[-1]])


SIDE = "block int, stripe int, n int, d int, top double, row binary, vec_id binary, has_id binary, label binary, v binary, lo binary, hi binary"
FOUND = "anchor_row long, w int, id long, score long"


def _pairs(anchors: DataFrame, buckets: DataFrame, blocks: int, stripes: int) -> DataFrame:
    """Blocks of anchors, once for each stripe, and the buckets that each may need (SIDE; anchors have lo, buckets don't)."""
    group = max(1, math.ceil(blocks / GROUPS))
    needs = anchors.groupBy(F.floor(F.col("block") / group).alias("g")).agg(F.min("need").alias("need")).orderBy("g").collect()
    low, groups = float("inf"), []
    for r in reversed(needs):  # at most GROUPS rows; blocks are in order of need, so a prefix of the groups wants a bucket
        low = min(low, r["need"])
        groups.append(low)
    if not groups:
        groups = [float("inf")]
    table = F.array(*[F.lit(x) for x in reversed(groups)])
    wanted = F.size(F.filter(table, lambda x: x <= F.col("top") * (1 + 1e-9))) * group
    wanted = F.least(wanted, F.lit(blocks))
    none = F.lit(None).cast("binary")
    sent = buckets.withColumn("wanted", wanted).where("wanted > 0")
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.col("wanted") - 1)).alias("block"), none.alias("lo"), none.alias("hi"))
    dealt = F.pmod(F.xxhash64("chunk"), F.lit(stripes)).cast("int")
    names = [x.split()[0] for x in SIDE.split(", ")]
    sent = sent.withColumn("stripe", dealt).select(*names)
    asked = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).select(*names)
    return asked.unionByName(sent)


def _search(anchors: DataFrame, buckets: DataFrame, blocks: int, stripes: int, k: int, same: bool) -> DataFrame:
    """FOUND: of each window the k best rows of each stripe."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None

        def results():
            if block is not None and block.best:
                keys = [(int(block.rows[a]), w, len(s)) for (a, w), (s, _) in block.best.items()]
                n = [x[2] for x in keys]
                arrays = [
                    pa.array(np.repeat([x[0] for x in keys], n)), pa.array(np.repeat([x[1] for x in keys], n).astype(np.int32)),
                    pa.array(np.concatenate([i for _, i in block.best.values()])), pa.array(np.concatenate([s for s, _ in block.best.values()])),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor_row", "w", "id", "score"])

        for b in batches:
            for r in b.to_pylist():
                n, v = r["n"], vectors.unpack(r["v"], r["n"], r["d"])
                if r["lo"] is not None:
                    yield from results()
                    shaped = lambda x: np.frombuffer(x, "<i8").reshape(n, -1)
                    at = (r["block"], r["stripe"])
                    block = Block(vectors.longs(r["row"]), vectors.longs(r["label"]), v, shaped(r["lo"]), shaped(r["hi"]), k, same)
                elif at == (r["block"], r["stripe"]):
                    ids = np.where(vectors.flags(r["has_id"]), vectors.longs(r["vec_id"]), NO_ID)
                    block.see(vectors.longs(r["row"]), ids, vectors.longs(r["label"]), v, r["top"])
        yield from results()

    common.batch_rows(anchors.sparkSession, 16)
    parts = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * stripes, 20_000))
    sides = _pairs(anchors, buckets, blocks, stripes)
    dealt = sides.repartition(parts, "block", "stripe").sortWithinPartitions("block", "stripe", F.col("lo").isNull(), F.desc("top"))
    return dealt.mapInArrow(work, FOUND)


def _blocks(anchors: DataFrame, blocks: int) -> DataFrame:
    """Anchors (row, label, v, lo, hi, need) in blocks of neighbouring needs, packed as in SIDE, with the block's least need."""
    ranged = anchors.repartitionByRange(blocks, "need", "row").sortWithinPartitions("need")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            d = len(b.column("v")[0]) if b.num_rows else 0
            for at in range(0, b.num_rows, BLOCK):
                c = b.slice(at, BLOCK)
                v = vectors.matrix(c.column("v"), d)
                raw = lambda name: c.column(name).flatten().to_numpy().astype("<i8").tobytes()
                flat = lambda name: c.column(name).to_numpy().astype("<i8").tobytes()
                found = [part, at, len(v), d, float(c.column("need").to_numpy().min()), flat("row"), flat("label"), v.astype("<i4").tobytes(), raw("lo"), raw("hi")]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, kinds)], names=["part", "at", "n", "d", "need", "row", "label", "v", "lo", "hi"])

    common.batch_rows(anchors.sparkSession, 4 * BLOCK)
    packed = ranged.select("row", "label", "v", "lo", "hi", "need").mapInArrow(
        work, "part int, at int, n int, d int, need double, row binary, label binary, v binary, lo binary, hi binary"
    )
    empty = F.lit(None).cast("binary")
    packed = common.stash(packed, "blocks")
    order = W.orderBy("need", "part", "at")  # over rows of BLOCK anchors, without their vectors
    numbers = packed.groupBy("part", "at", "need").agg(F.first("n").alias("n")).select("part", "at", (F.row_number().over(order) - 1).alias("block"))
    return packed.join(numbers, ["part", "at"]).withColumns({"top": F.lit(0.0), "vec_id": empty, "has_id": empty})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_row", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor.

    rows: row, vec_id, label (not null), v as vectors.integers gives them; anchors: those of them that ask. The score of a
    row is its inner product with the anchor; of equal scores the smaller vec_id comes first, null ones last. An anchor's
    positives are its first `positives` other rows with its label; the negatives of each are the first `negatives` rows
    with another label whose score is `least` to `most` per cent of the positive's. A window that admits no row gives
    none. Repeated rows are rows of their own; no rows or no anchors give no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = rows.withColumn("__norm", vectors.norm(F.col("v")))
    ordered = sized.repartitionByRange(parts, F.desc("__norm"), F.hash("row")).sortWithinPartitions(F.desc("__norm"))
    buckets = common.stash(vectors.pack(ordered.drop("__norm")), "buckets")
    asking = common.stash(anchors.select("row", "vec_id", F.col("label").cast("long").alias("label"), "v"), "anchors")
    count = asking.count()
    blocks = lambda n: max(1, math.ceil(n / BLOCK))
    stripes = lambda n: max(1, math.ceil(parts / n))
    lone = lambda x: F.array(F.lit(x).cast("long"))
    first = _blocks(asking.select("*", lone(LOWEST).alias("lo"), lone(HIGHEST).alias("hi"), F.lit(-float("inf")).alias("need")), blocks(count))
    first = common.stash(first, "first-blocks")
    n = max(1, first.count())
    found = _best(_search(first, buckets, n, stripes(n), positives, same=True), positives)
    found = common.stash(found.select("anchor_row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers s with least * p <= 100 * s <= most * p, for each positive in its order.
    p = lambda x: x["positive_score"]
    low = lambda x: F.floor((p(x) * least + 99) / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = lambda x: F.floor(p(x) * most / F.lit(100).cast("decimal(3,0)")).cast("long")
    own = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))  # up to `positives`
    pad = lambda a, x: F.slice(F.concat(a, F.array_repeat(F.lit(x).cast("long"), positives)), 1, positives)
    asked = asking.join(own, F.col("row") == F.col("anchor_row")).select(
        "row", "label", "v", pad(F.transform("p", low), HIGHEST).alias("lo"), pad(F.transform("p", high), LOWEST).alias("hi")
    )
    # The norm that a bucket needs at least: that of the lowest window over the anchor's own norm.
    lowest = F.array_min(F.zip_with("lo", "hi", lambda a, b: F.when(a <= b, a)))
    length = vectors.norm(F.col("v"))
    need = F.when(lowest.isNull(), float("inf")).when(lowest <= 0, -float("inf")).when(length == 0, float("inf")).otherwise(lowest / length)
    asked = asked.withColumn("need", need).where(need < float("inf"))
    second = common.stash(_blocks(asked, blocks(count)), "second-blocks")
    n = max(1, second.count())
    hard = _best(_search(second, buckets, n, stripes(n), negatives, same=False), negatives)
    hard = hard.select("anchor_row", (F.col("w") + 1).alias("p_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asking.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = hard.join(found.withColumnRenamed("rank", "p_rank"), ["anchor_row", "p_rank"]).join(ids, "anchor_row")
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, factor: int = 256, every: int = 100) -> DataFrame:
    """mine() for the rows of embeddings whose vec_id is divisible by `every`, against all rows.

    Rows with a null label take no part, nor do those that vectors.integers leaves out. Where vec_id is divisible by 7,
    the label is first made wrong: (label + 1) % 10.
    """
    rows = vectors.integers(embeddings.where("label is not null"), factor)
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = rows.withColumn("label", wrong)
    return mine(rows, rows.where(F.col("vec_id") % every == 0))


ORACLE_SQL = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 10"""
