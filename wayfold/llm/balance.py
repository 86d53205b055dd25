"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each document gets the rate w = most / (1 + (most - 1) exp(-l z)), the exponential tilt of rate 1 that stays under
`most`; z is its size over its source's mean, l its source's multiplier. The multipliers solve the convex dual of "least
relative entropy, given each source's tokens": one Newton step is one aggregate over a table of distinct sizes. Rates are
then rounded into whole copies, by running sums over ascending sizes, and the last words by moving single copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.llm import common

#: Newton steps until an error is raised, and the relative error in tokens at which they end.
STEPS, CLOSE = 100, 1e-7
#: Parts that the documents of one source and size are counted in.
SALTS = 256
#: Single copies moved for each source after rounding.
MOVES = 3


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words; a null text has none) of every document."""
    return common.only(documents, "doc_id", "source", "text").select(
        "doc_id", "source", common.word_count(F.col("text")).alias("size")
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, docs, source_size, target, capped. Sources by code point, null last, take the weights in turn.

    The sources share `share` of all words by weight; none gets over `most` times its size, and what that leaves goes to
    the others by weight. Sorted by (cap / weight), the capped sources are a prefix, which running sums find at once.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    table = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        .withColumn("weight", F.element_at(listed, (rank + 1).cast("int")))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = W.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("capped", F.col("ratio") * heavy <= left)
    rest = F.lit(share) * F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / open_)
    return table.select("source", "docs", "source_size", target.alias("target"), "capped")


def _rate(tilt: Column, z: Column, most: float) -> Column:
    return F.lit(most) / (1 + F.lit(most - 1) * F.exp(-tilt * z))


def solve(cells: DataFrame, aims: DataFrame, most: float = 2.0) -> DataFrame:
    """aims with each source's multiplier `tilt`: safeguarded Newton steps on the dual, all sources in each step.

    cells: source, size, n (documents of that size). A step outside the bracket of the root is replaced by halving it.
    """
    state = common.stash(
        aims.withColumns({"tilt": F.lit(0.0), "low": F.lit(-4096.0), "high": F.lit(4096.0), "error": F.lit(1.0)}), "tilts"
    )
    for _ in range(STEPS):
        z = F.col("size") * F.col("docs") / F.col("source_size")
        rate = _rate(F.col("tilt"), z, most)
        rated = common.null_safe(cells, state.where("not capped and source_size > 0"), ["source"]).withColumns({"z": z, "rate": rate})
        sums = rated.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("tokens"),
            F.sum(F.col("n") * F.col("size") * F.col("z") * F.col("rate") * (1 - F.col("rate") / most)).alias("slope"),
        )
        off = F.col("tokens") - F.col("target")
        stepped = common.null_safe(state, sums, ["source"], "left").withColumns(
            {
                "low": F.when(off < 0, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(off > 0, F.col("tilt")).otherwise(F.col("high")),
                "error": F.coalesce(F.abs(off) / F.greatest("target", F.lit(1.0)), F.lit(0.0)),
                "newton": F.col("tilt") - off / F.col("slope"),
            }
        )
        tilt = (
            F.when((F.col("error") <= CLOSE) | F.col("tokens").isNull(), F.col("tilt"))
            .when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton"))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        old, state = state, common.stash(stepped.select(*aims.columns, tilt.alias("tilt"), "low", "high", "error"), "tilts")
        common.drop(old)
        if (state.agg(F.max("error")).first()[0] or 0.0) <= CLOSE:
            break
    else:
        raise RuntimeError(f"the tokens of a source are still off their target after {STEPS} steps")
    return state.select(*aims.columns, "tilt")


def round_cells(cells: DataFrame, solved: DataFrame, most: float = 2.0) -> DataFrame:
    """cells with `copies`, the whole number of copies that the documents of each source and size get altogether.

    The running sum of rates by ascending size is rounded, so that a source's tokens are off by less than its largest
    size; then MOVES times the copy whose size comes closest to the error is added or dropped.
    """
    z = F.col("size") * F.col("docs") / F.greatest("source_size", F.lit(1))
    rate = F.when(F.col("capped"), F.lit(most)).otherwise(_rate(F.col("tilt"), z, most))
    rated = common.null_safe(cells, solved, ["source"]).withColumn("mass", F.col("n") * rate)
    upto = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    done = F.sum("mass").over(upto)
    copies = F.floor(done + 0.5) - F.floor(done - F.col("mass") + 0.5)
    ceiling = F.floor(F.lit(most) * F.col("n"))
    table = common.stash(
        rated.select("source", "size", "n", "source_size", "target", F.greatest(F.lit(0), F.least(copies, ceiling)).cast("long").alias("copies")),
        "copies",
    )
    for _ in range(MOVES):
        error = table.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("short"))
        near = common.null_safe(table, error, ["source"])
        can = (F.col("size") > 0) & F.when(F.col("short") > 0, F.col("copies") < ceiling).otherwise(F.col("copies") > 0)
        gain = F.abs(F.col("short")) - F.abs(F.abs(F.col("short")) - F.col("size"))
        moves = near.where(can & (gain > 0)).groupBy("source").agg(
            F.max_by("size", F.struct(gain, "size")).alias("moved"), F.first(F.signum("short")).alias("by")
        )
        moved = F.when(F.col("size") == F.col("moved"), F.col("by")).otherwise(0)
        table = common.stash(
            common.null_safe(table, moves, ["source"], "left").select(
                *[c for c in table.columns if c != "copies"], (F.col("copies") + F.coalesce(moved, F.lit(0))).cast("long").alias("copies")
            ),
            "copies",
        )
    return table


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every document; the same in every run.

    Which of the documents of one source and size get one copy more goes by a hash of doc_id, in SALTS parts, so that
    many documents of one size are never sorted in one task. Null sources are one source, the last; null texts and
    texts without words have size 0. Repeated rows count as documents of their own. Empty tables give no rows.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    sized = common.stash(sizes(documents).withColumn("salt", salt), "sizes")
    aims = common.stash(targets(sized, weights, share, most), "targets")
    parts = common.stash(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "parts")
    cells = common.stash(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    rounded = round_cells(cells, solve(cells, aims, most), most)
    before = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("source", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    given = common.null_safe(starts, rounded, ["source", "size"])
    own = W.partitionBy("source", "size", "salt").orderBy(F.asc_nulls_first("doc_id"))
    placed = common.null_safe(sized.withColumn("k", F.row_number().over(own) - 1), given, ["source", "size", "salt"])
    base = F.floor(F.col("copies") / F.col("n"))
    copies = base + F.when(F.col("start") + F.col("k") < F.col("copies") - base * F.col("n"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("int")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def repeat(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of documents as many times as `mixed` has copies of it.

    Rows of one doc_id are told apart by size, and where these are equal too they take the copies in any order. Null
    doc_ids match each other. Extra columns are kept.
    """
    own = [F.col(f"`{c}`") for c in documents.columns]
    spread = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    ids = common.stash(mixed.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"), F.min("copies").alias("__copies")), "mixed-ids")
    joined = documents.join(ids, documents["doc_id"].eqNullSafe(ids["__id"]))
    single = joined.where("__rows = 1 and __copies > 0").withColumn("__copy", spread).select(*own)
    if ids.where("__rows > 1").isEmpty():
        return single
    rows = W.partitionBy("__id", "__size")
    numbered = joined.where("__rows > 1").drop("__copies").withColumn("__size", common.word_count(F.col("text")))
    numbered = numbered.withColumn("__k", F.row_number().over(rows.orderBy(F.xxhash64("text"))))
    copies = mixed.select(F.col("doc_id").alias("__i"), F.col("size").alias("__s"), F.col("copies").alias("__copies"))
    copies = copies.withColumn("__n", F.row_number().over(W.partitionBy("__i", "__s").orderBy("__copies")))
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__size") == F.col("__s")) & (F.col("__k") == F.col("__n"))
    many = numbered.join(copies.where("__copies > 0"), on).withColumn("__copy", spread).select(*own)
    return single.unionByName(many)
