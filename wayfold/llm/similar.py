"""Jaccard join of documents on five-word shingles by chosen paths.

Every set of shingles gets a signature of least hashes. Each run splits all sets on two places of the signature: sets
that agree there share a node. Nodes of up to SMALL sets are compared by brute force; larger ones are split again on two
more places. Every split of every run has a place of its own, so they are independent: a pair of likeness 0.8 keeps a
common node with odds over 0.93 in each run, however deep it goes, and the runs for a target recall follow from these odds.

In a large node every signature is compared with the node's centre too, the most frequent value at each place among about
CENTRE of its sets: sets near the centre are candidates with each other, and those very near need no more splitting,
since whatever is like them is near the centre as well: a partner that is not a candidate differs from such a set in
more than SURELY - MAYBE of the places, whatever the centre, and these odds count into the runs. So a large group of
near copies ends at once, and of one whose copies differ from each other by most of their shingles few sets are split on:
both bounds are low, since a false candidate costs one exact comparison, but a set that is split goes on in two nodes.

What these comparisons of signatures join are only candidate clusters. Within each cluster every pair is then compared
exactly, on the sets themselves; a cluster over BLOCK sets is compared in pairs of blocks, for which each set is sent
once for every BLOCK sets of its cluster. Only links' ends, counts and representatives leave a task. Documents of equal sets are one set with a count from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import common
from wayfold.llm.common import DOUBLE, INT, LONG, schema
from wayfold.llm.components import components

SHINGLE, LIKE = 5, 0.8
#: Sets that a node may have to be compared at once; levels of splits; sets of a block.
SMALL, DEPTH, BLOCK = 64, 5, 2048
#: Places of a run: splits of its tree, numbered as in a heap with two roots.
TREE = 2 ** (DEPTH + 1) - 2
#: Sets that a large node's centre is taken from, about.
CENTRE = 64
#: Estimated likeness from which two sets of a small node are candidates, that to a node's centre from which sets are
#: candidates with each other, and that from which a set is split no more.
LIKELY, MAYBE, SURELY = 0.66, 0.35, 0.67
RECALL = 0.999


def _differ_odds(places: int, like: float, least: int) -> float:
    """Odds that two sets of likeness `like` differ in `least` or more of the places."""
    return sum(math.comb(places, k) * (1 - like) ** k * like ** (places - k) for k in range(least, places + 1))


def lost_odds(runs: int, like: float = LIKE) -> float:
    """Bound of the odds that a pair has a common node in no run, or is passed over by a comparison of signatures."""
    kept, places = 1.0, TREE * runs
    for _ in range(DEPTH):
        kept = 1 - (1 - like * kept) ** 2
    maybe, surely = math.ceil(MAYBE * places), math.ceil(SURELY * places)
    return (1 - kept) ** runs + _differ_odds(places, like, surely - maybe + 1) + _differ_odds(places, like, places - math.ceil(LIKELY * places) + 1)


def runs_needed(recall: float = RECALL, like: float = LIKE) -> int:
    return next(r for r in range(1, 17) if lost_odds(r, like) <= 1 - recall)


RUNS = runs_needed()
PLACES = TREE * RUNS
#: Places that split all sets, of which a signature holds the upper halves too.
ROOTS = [TREE * r + k for r in range(RUNS) for k in range(2)]

_rng = np.random.default_rng(20240521)
_MUL = (_rng.integers(0, 1 << 31, PLACES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PLACES, dtype=np.uint32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)
_words: dict[bytes, int] = {}


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; a text of fewer words has one run, of all of them."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 1_000_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        x += h[i : i + n] * _POWERS[i]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(found: np.ndarray) -> bytes:
    """The lower halves of the least hashes at all places, then the upper halves of those at ROOTS."""
    low = (found >> np.uint64(20)).astype(np.uint32)
    out = np.full(PLACES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(out, (low[i : i + 256, None] * _MUL + _ADD).min(axis=0), out=out)
    return out.astype("<u2").tobytes() + (out[ROOTS] >> np.uint32(16)).astype("<u2").tobytes()


def _signed(x: int | None) -> int | None:
    return None if x is None else x - (1 << 64) if x >= 1 << 63 else x


def set_id(found: np.ndarray) -> int | None:
    return _signed(xxhash.xxh3_64_intdigest(found.tobytes())) if len(found) else None


def sketches(documents: DataFrame, text_ids: bool = False) -> DataFrame:
    """doc_id, set_id (null for a text without words), sig of every row; with text_ids also text_id, a hash of its text."""
    kept = ["doc_id", "text_id"] if text_ids else ["doc_id"]
    out = schema(**dict.fromkeys(kept, LONG), set_id=LONG, sig=T.BinaryType())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "") for t in b.column("text").to_pylist()]
            ids = pa.array([set_id(s) for s in sets], pa.int64())
            sigs = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ids, sigs], names=out.names)

    rows = common.only(documents, "doc_id", "text")
    return (rows.withColumn("text_id", F.xxhash64("text")) if text_ids else rows).mapInArrow(sketch, out)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, PLACES + len(ROOTS))[:, :PLACES]


def stars(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the least index of each index's component."""
    n = len(linked)
    root = np.arange(n)
    seen = np.zeros(n, dtype=bool)
    for i in range(n):
        if not seen[i]:
            front = np.array([i])
            seen[i] = True
            while len(front):
                root[front] = i
                new = linked[front].any(axis=0) & ~seen
                seen |= new
                front = np.flatnonzero(new)
    return root


EDGE = schema(a=LONG, b=LONG)


def _small_nodes(rows: DataFrame) -> DataFrame:
    """Candidate edges within nodes of few sets, by their signatures; a node gives fewer edges than it has sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def edges(nodes, ids, sigs):
            cut = np.flatnonzero(np.diff(nodes)) + 1
            a, b = [], []
            for i, j in zip(np.r_[0, cut].tolist(), np.r_[cut, len(nodes)].tolist()):
                if j - i > 1:
                    s = sigs[i:j]
                    linked = (s[:, None, :] == s[None, :, :]).mean(axis=2, dtype=np.float32) >= LIKELY
                    root = stars(linked)
                    for k in np.flatnonzero(root != np.arange(j - i)):
                        a.append(int(ids[i + root[k]]))
                        b.append(int(ids[i + k]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=EDGE.names)

        for batch in batches:
            nodes, ids, sigs = batch.column("node").to_numpy(), batch.column("set_id").to_numpy(), _matrix(batch.column("sig"))
            if left is not None:
                nodes, ids, sigs = (np.concatenate(x) for x in zip(left, (nodes, ids, sigs)))
            if not len(nodes):
                continue
            last = int(np.searchsorted(nodes, nodes[-1]))
            yield edges(nodes[:last], ids[:last], sigs[:last]) if last else pa.RecordBatch.from_pylist([], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            left = nodes[last:], ids[last:], sigs[last:]
        if left is not None:
            yield edges(*left)

    return rows.select("node", "set_id", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(compare, EDGE)


def _centres(rows: DataFrame) -> DataFrame:
    """(node, centre) of large nodes from rows of about CENTRE sets of each."""
    out = T.StructType([*schema(node=LONG, centre=T.BinaryType()).fields])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def mode() -> bytes:
            found = np.sort(np.stack(held), axis=0)
            start = np.arange(len(found))[:, None] * np.ones(PLACES, dtype=int)
            start[1:][found[1:] == found[:-1]] = 0
            run = np.arange(len(found))[:, None] - np.maximum.accumulate(start, axis=0)
            return found[run.argmax(axis=0), np.arange(PLACES)].astype("<u2").tobytes() + bytes(2 * len(ROOTS))

        for b in batches:
            done = []
            for n, sig in zip(b.column("node").to_pylist(), _matrix(b.column("sig"))):
                if n != node and held:
                    done.append((node, mode()))
                    held = []
                node = n
                held.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], names=out.names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([mode()], pa.binary())], names=out.names)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(centre, out)


def _near_centre(rows: DataFrame) -> DataFrame:
    """rows with `near`, the share of places at which sig and centre agree."""
    out = schema(node=LONG, set_id=LONG, at=INT, sig=T.BinaryType(), near=DOUBLE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column("sig")) == _matrix(b.column("centre"))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out.names[:-1]), pa.array(near, pa.float64())], names=out.names)

    return rows.mapInArrow(compare, out)


def _children(rows: DataFrame, places: list, upper: list | None = None) -> DataFrame:
    """rows with node replaced by one child node for each place: a hash of node, place and the value there; at is its place.
    upper: where in the signature the upper halves of these values are."""
    half = lambda k: F.substring("sig", k * 2 + 1, F.lit(2))
    values = [[half(k), *([half(upper[i])] if upper else [])] for i, k in enumerate(places)]
    child = [F.struct(F.xxhash64("node", k, *v).alias("node"), k.cast("int").alias("at")) for k, v in zip(places, values)]
    return rows.select("set_id", F.explode(F.array(*child)).alias("child")).select("child.node", "set_id", "child.at")


def candidates(reps: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between sets (set_id, sig) whose components hold every likely pair."""
    runs = runs_needed(recall)
    if runs > RUNS:
        raise ValueError(f"a recall of {recall} takes {runs} runs, signatures have places for {RUNS}")
    roots = reps.select("set_id", "sig", F.lit(0).cast("long").alias("node"))
    placed = _children(roots, [F.lit(k) for k in ROOTS[: 2 * runs]], [F.lit(PLACES + i) for i in range(2 * runs)])
    found = []
    for depth in range(1, DEPTH + 1):
        placed = common.stash(placed.select("node", "set_id", "at"), "paths")
        total = placed.count()
        shared = placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = common.stash(common.join_counted(placed, shared, ["node"], total).join(reps.select("set_id", "sig"), "set_id"), "nodes")
        common.drop(placed)
        found.append(common.stash(_small_nodes(rows.where(F.col("n") <= SMALL)), "edges"))
        large = rows.where(F.col("n") > SMALL).select("node", "set_id", "at", "sig", "n")
        some = large.where(F.pmod(F.xxhash64("set_id", "node"), F.col("n")) < CENTRE).select("node", "sig")
        centres = common.stash(_centres(some), "centres")
        if centres.isEmpty():
            break
        # A large node without a centre would have no set of a hash under CENTRE; its centre is then one that agrees with none.
        sizes = large.groupBy("node").agg(F.count("*").alias("n")).join(centres, "node", "left")
        sizes = sizes.withColumn("centre", F.coalesce("centre", F.lit(bytes(2 * (PLACES + len(ROOTS))))))
        near = common.stash(_near_centre(common.join_counted(large.drop("n"), sizes, ["node"], total)), "near")
        common.drop(rows, centres)
        # At the last level all of a node are candidates: they agree in as many places as there are levels.
        close = near.where(F.col("near") >= (MAYBE if depth < DEPTH else 0.0)).select("node", "set_id")
        hubs = close.groupBy("node").agg(F.min("set_id").alias("a"), F.count("*").alias("n"))
        joined = common.join_counted(close, hubs, ["node"], total).where("a <> set_id")
        found.append(common.stash(joined.select("a", F.col("set_id").alias("b")), "edges"))
        below = F.col("at") + F.col("at") % TREE + 2
        placed = _children(near.where(F.col("near") < SURELY), [below, below + 1])
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


UNIT = ["root", "i", "j"]


def exact_pairs(sets: list[np.ndarray], cross: np.ndarray | None, like: float = LIKE) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard likeness is `like` or more; cross gives each set's block, and
    then only pairs of different blocks are looked at."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both >= like * (sizes.sum() - both) - 1e-9
        return np.array([[False, hit], [hit, False]])
    owner = np.repeat(np.arange(m), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    columns, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    common_ = np.zeros((m, m), dtype=np.float32)  # counts under 2^24, so exact
    width = 1024
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(columns, [low, low + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[a:b], columns[a:b] - low] = 1
        common_ += part @ part.T
    hit = np.empty((m, m), dtype=bool)
    for i in range(0, m, 256):
        both = common_[i : i + 256].astype(np.float64)
        hit[i : i + 256] = both >= like * (sizes[i : i + 256, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(hit, False)
    if cross is not None:
        hit &= cross[:, None] != cross[None, :]
    return hit


LINK = schema(set_id=LONG, parent=LONG, whole=INT, links=LONG, sets=LONG)


def _verify(units: DataFrame, like: float) -> DataFrame:
    """For each set of a unit its parent (the least set of its component there), and its linked documents and sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def links(rows: list[dict]) -> pa.RecordBatch:
            sets = [np.frombuffer(r["found"], dtype="<u8") for r in rows]
            two = rows[0]["i"] != rows[0]["j"]
            hit = exact_pairs(sets, np.array([r["block"] for r in rows]) if two else None, like) if len(rows) > 1 else np.zeros((1, 1), bool)
            root, weight = stars(hit), np.array([r["copies"] for r in rows], dtype=np.int64)
            out = [
                {"set_id": r["set_id"], "parent": rows[root[k]]["set_id"], "whole": int(r["blocks"] == 1), "links": int(weight[hit[k]].sum()), "sets": int(hit[k].sum())}
                for k, r in enumerate(rows)
            ]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("set_id", pa.int64()), ("parent", pa.int64()), ("whole", pa.int32()), ("links", pa.int64()), ("sets", pa.int64())]))

        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][c] != r[c] for c in UNIT):
                    yield links(held)
                    held = []
                if not held or held[-1]["set_id"] != r["set_id"]:
                    held.append(r)
        if held:
            yield links(held)

    dealt = units.repartition(*UNIT).sortWithinPartitions(*UNIT, "set_id")
    return dealt.mapInArrow(compare, LINK)


def join(documents: DataFrame, like: float = LIKE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row: links go to all other rows whose shingles have a Jaccard likeness of
    `like` or more (equal texts too), and a class is what links connect, named by its least doc_id.

    Null and wordless texts have no links and are classes of their own. Repeated rows count as documents. Null doc_ids
    are kept. Links between different texts are exact among the candidates, which hold a pair of likeness `like` with
    odds of `recall` or more; none is dropped for the size of its group. An empty table gives no rows.
    """
    drawn, named = _classes(documents, like, recall)
    return common.join_counted(drawn.select("doc_id", "set_id"), named.select("set_id", "class_id", "n_links", "n"), ["set_id"], drawn.count(), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _classes(documents: DataFrame, like: float, recall: float, text_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each set of shingles its class: set_id, parent (a set, one for each class), class_id,
    n_links, n (rows with the set)."""
    common.batch_rows(documents.sparkSession, 500)
    drawn = common.stash(sketches(documents, text_ids), "sketches")
    reps = drawn.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig")
    )
    reps = common.stash(reps, "sets")
    clusters = common.stash(components(candidates(reps, recall)), "clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = (
        clusters.join(sizes, "root")
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
        .join(reps.select(F.col("set_id").alias("node"), "rep", "copies"), "node")
        .withColumnRenamed("node", "set_id")
    )
    members = common.stash(members, "members")
    kept = ["set_id", "root", "blocks", "block", "copies"]
    out = schema(set_id=LONG, root=LONG, blocks=INT, block=INT, copies=LONG, found=T.BinaryType())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # a set's rows have one doc_id, so they meet in this task, or in a few if the join is split
        for b in batches:
            sets = [shingles(t or "") for t in b.column("text").to_pylist()]
            ids = b.column("set_id").to_pylist()
            same = pa.array([i not in done and set_id(s) == i and not done.add(i) for s, i in zip(sets, ids)], pa.bool_())
            found = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), found], names=out.names).filter(same)

    texts = common.only(documents, "doc_id", "text").hint("merge").join(members, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", *kept)
    sets = texts.mapInArrow(again, out)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.withColumn("k", other).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
    verified = common.stash(_verify(units.select(*out.names, "i", "j"), like), "links")
    # A unit of one block is compared within both of the block's sides only once, so sums over units are right.
    counts = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    whole = verified.where("whole = 1").select("set_id", "parent")
    parts = components(verified.where("whole = 0 and set_id <> parent").select(F.col("set_id").alias("a"), F.col("parent").alias("b")))
    roots = whole.unionByName(parts.select(F.col("node").alias("set_id"), F.col("root").alias("parent")))
    table = reps.join(counts, "set_id", "left").join(roots, "set_id", "left").select(
        "set_id", "rep", F.coalesce("parent", "set_id").alias("parent"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n"),
    )
    table = common.stash(table, "classes")
    names = table.groupBy("parent").agg(F.min("rep").alias("class_id"))
    return drawn, common.stash(table.join(names, "parent").select("set_id", "parent", "class_id", "n_links", "n"), "named")


def keep_one(documents: DataFrame, like: float = LIKE, recall: float = RECALL) -> DataFrame:
    """documents without near copies: of each class of links one row stays, that of the least doc_id, null ones last, and
    of several with that id the one whose text hashes least.

    So a row goes though its doc_id names the class, if another text of that id stays for it. Null and wordless texts are in no
    class: all stay. Rows with equal doc_id and text are one. Extra columns are kept; an empty table gives no rows.
    """
    drawn, named = _classes(documents, like, recall, text_ids=True)
    rows = common.join_counted(drawn.select("doc_id", "text_id", "set_id"), named.select("set_id", "parent", "n"), ["set_id"], drawn.count(), "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id"))
    of_class = rows.where("parent is not null").groupBy("parent").agg(first.alias("f")).select("f.doc_id", "f.text_id")
    kept = of_class.unionByName(rows.where("parent is null").select("doc_id", "text_id")).distinct()
    kept = common.stash(kept.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id")), "kept")
    same = documents["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(documents["text"]) == kept["__text_id"])
    left = documents.join(kept, same, "left_semi")
    # Equal rows are looked for where an id is repeated, by a count without the texts.
    repeated = drawn.groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
