"""Edges of a street chained to polylines, each edge once, by joins and pointer jumping.

At every node of a street the ends of its edges are paired: an end that may only arrive with one that may only leave, what
is left of either with ends of two-way edges, and those with one another. Pairs make every edge, in each direction in which
it may be driven, follow at most one other, so that chains are linked lists; their order comes by doubling pointers, in as
many rounds as the longest has binary digits, and no task holds a street.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.operators.numbering import cut, drop


def _pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edge, side, to_edge, to_side: ends of edges of one street that are paired at a node, in both orders."""
    way = lambda only: F.when(F.col("reversible"), "r").otherwise(only)
    ends = edges.select(*keys, "edge", F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("side"), way("l").alias("kind")),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("side"), way("a").alias("kind")),
    )).alias("e")).select(*keys, "edge", "e.*")
    here = W.partitionBy(*keys, "node")
    number = F.row_number().over(W.partitionBy(*keys, "node", "kind").orderBy("side", "edge"))
    n = {k: F.sum((F.col("kind") == k).cast("int")).over(here) for k in "alr"}
    ends = ends.withColumn("i", number).withColumns({f"n_{k}": n[k] for k in "alr"})
    both, more = F.least("n_a", "n_l"), F.abs(F.col("n_a") - F.col("n_l"))
    beyond = F.col("i") - F.least(more, F.col("n_r"))
    two_way = F.when(beyond <= 0, both + F.col("i")).otherwise(both + more + F.ceil(beyond / 2))
    ends = ends.withColumn("slot", F.when(F.col("kind") == "r", two_way).otherwise(F.col("i")).cast("int"))
    mates = ends.groupBy(*keys, "node", "slot").agg(F.collect_list(F.struct("edge", "side")).alias("m")).where("size(m) = 2")
    a, b = F.col("m")[0], F.col("m")[1]
    both_ways = F.explode(F.array(F.struct(a.alias("f"), b.alias("t")), F.struct(b.alias("f"), a.alias("t"))))
    pairs = mates.select(both_ways.alias("p")).select("p.f.edge", "p.f.side", F.col("p.t.edge").alias("to_edge"), F.col("p.t.side").alias("to_side"))
    return pairs


def chains(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, pos, edge, reversed: the pieces that the edges of one street (equal keys) form, and each edge's place.

    edges: keys (null ones are streets too), edge (unique), source, target, reversible. Every edge is in one piece, once; a
    neighbour in a piece begins where the last one ends, and only reversible edges are reversed. A street of two-way edges
    alone has the least possible number of open pieces, half that of its nodes with an odd number of ends; closed pieces
    stay on their own. Two-way edges between one-way edges that point at each other go with one of these. A piece has the
    number of its first edge; a closed one begins at its least edge. No edges give no pieces.
    """
    keyed = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"__{k}") for k in keys]
    named = [f"__{k}" for k in keys]
    plain = cut(edges.select(*keys, *keyed, "edge", "source", "target", "reversible"))
    # A state is an edge in a direction: 2 x edge, and 1 more against it. It follows the state that leaves by its entry's mate.
    pairs = _pairs(plain.select(*named, "edge", "source", "target", "reversible"), named)
    before = pairs.select((2 * F.col("edge") + F.col("side")).alias("state"), (2 * F.col("to_edge") + 1 - F.col("to_side")).alias("prev"))
    states = plain.select("edge", "reversible", F.explode(F.when(F.col("reversible"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("back"))
    states = states.select((2 * F.col("edge") + F.col("back")).alias("state"), "reversible")
    before = before.join(states.select("state"), "state", "left_semi").join(states.select(F.col("state").alias("prev")), "prev", "left_semi")
    # head: the state that jumps have come to, far: how many states back; low: the least on the way, to open closed chains.
    jumps = cut(states.join(before, "state", "left").select("state", "reversible", F.col("prev"), F.least("state", "prev").alias("low"), F.coalesce("prev", "state").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("far")))
    fixed = _ranked(jumps)
    closed = fixed.where("open").select("state", "low")
    if not closed.isEmpty():
        # A chain in which every state follows another is closed: its least state becomes its first.
        opened = jumps.join(closed.select("state", F.col("low").alias("least")), "state", "left")
        first = F.col("state") == F.col("least")
        opened = opened.select("state", "reversible", F.when(first, None).otherwise(F.col("prev")).alias("prev"), "low", F.when(first, F.col("state")).otherwise(F.coalesce("prev", "state")).alias("head"), F.when(first, 0).otherwise(F.when(F.col("prev").isNull(), 0).otherwise(1)).cast("long").alias("far"))
        again = cut(opened)
        drop(fixed)
        fixed = _ranked(again)
    # Of the two directions of a two-way edge the one counts whose chain has a one-way edge; else that with the lesser end.
    sizes = fixed.groupBy("head").agg(F.max((~F.col("reversible")).cast("int")).alias("bound"), F.min("state").alias("least"))
    placed = fixed.join(sizes, "head").withColumn("edge", F.floor(F.col("state") / 2))
    best = F.row_number().over(W.partitionBy("edge").orderBy(F.desc("bound"), "least", "head", "state"))
    kept = placed.withColumn("k", best).where("k = 1").select("edge", "head", "far", (F.col("state") % 2 == 1).alias("reversed"))
    along = W.partitionBy("head").orderBy("far")
    piece = F.first("edge").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    kept = kept.select("edge", "reversed", piece.alias("piece"), (F.row_number().over(along) - 1).cast("long").alias("pos"))
    return plain.select(*keys, "edge").join(kept, "edge").select(*keys, "piece", "pos", "edge", "reversed")


def _ranked(jumps: DataFrame) -> DataFrame:
    """state, reversible, head, far, low, open of each state after doubling: open says that it reached no first state."""
    at, step = jumps.withColumn("open", F.col("head") != F.col("state")), 1
    ends = jumps.where("prev is null").select(F.col("state").alias("head"), F.lit(True).alias("ended"))
    at = cut(at.join(ends, "head", "left").withColumn("open", F.col("open") & F.col("ended").isNull()).drop("ended", "prev"))
    size, left = at.count(), at.where("open").count()
    while left and step < 2 * size:
        mate = at.select(F.col("state").alias("head"), F.col("head").alias("h2"), F.col("far").alias("f2"), F.col("low").alias("l2"), F.col("open").alias("o2"))
        moved = at.where("open").join(mate, "head").select("state", "reversible", F.col("h2").alias("head"), (F.col("far") + F.col("f2")).alias("far"), F.least("low", "l2").alias("low"), F.col("o2").alias("open"))
        new = cut(at.where("not open").select("state", "reversible", "head", "far", "low", "open").unionByName(moved))
        drop(at)
        at, step = new, 2 * step
        left = at.where("open").count()
    return at
