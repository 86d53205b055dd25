"""I-Match fingerprints: terms within a band of inverse document frequency, sorted and distinct, hashed over several
randomised subsets of that lexicon.

A fingerprint is one hash for each subset: of the sorted list of those of the text's distinct terms that the subset holds.
The subsets are drawn at several rates, so that a short text has some subset with a few of its terms, and a long text
some subset with only a few: one rate of the original method fits one length. Where a text has under `least` terms in the
band, all its terms count (with `least` 0 they never do, and a text without terms in the band has zeros alone).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import common
from wayfold.llm.common import DOUBLE, INT, LONG, STRING, schema

TERM = re.compile(r"\w+")
#: A subset of level r holds each term with probability 1 / r; there are SUBSETS of each.
RATES, SUBSETS = (1, 4, 16, 64, 256, 1024), 24
#: The band: terms of at least LOW and at most HIGH of all texts (and of two texts at least).
LOW, HIGH, LEAST = 0.001, 0.2, 4
#: Terms of the lexicon beyond which an error is raised, since it goes to every task.
MOST_TERMS = 3_000_000
_FLUSH = 400_000


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def lexicon(documents: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """The terms within the band, sorted. Document frequencies are counted over all documents.

    At most (mean distinct terms of a text) / low terms can lie within it, however many documents there are: a few
    hundred thousand for ordinary texts. So they are collected and broadcast; more than MOST_TERMS raise an error.
    """
    docs = common.only(documents, "text").where(F.col("text").isNotNull())
    n = documents.count()
    out = schema(term=STRING, n=LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=out.names)
            seen.clear()
            return batch

        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(terms(text))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    found = docs.mapInArrow(count, out).groupBy("term").agg(F.sum("n").alias("n"))
    band = found.where((F.col("n") >= max(2, math.ceil(low * n))) & (F.col("n") <= max(2, high * n)))
    band = common.stash(band.select("term"), "lexicon")
    if band.count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms within the band; raise `low`")
    terms_ = sorted(r["term"] for r in band.toLocalIterator())
    common.drop(band)
    return terms_


_SEEDS = np.array([xxhash.xxh64_intdigest(f"subset {i}") for i in range(len(RATES) * SUBSETS)], dtype=np.uint64)
_LIMITS = np.repeat(np.array([(1 << 64) // r - 1 for r in RATES], dtype=np.uint64), SUBSETS)


_POWERS = np.array([1], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... for a fixed odd B, n of them at least."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(pow(0x9E3779B97F4A7C15, len(_POWERS), 1 << 64))])
    return _POWERS


def subset_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each subset the 16-bit hash of the list of those terms (given by their hashes, in the order of the terms) that
    it holds: a polynomial in their hashes, so the order counts; 0 where it holds none."""
    out = np.zeros(len(_SEEDS), dtype=np.uint64)
    sizes = np.zeros(len(_SEEDS), dtype=np.int64)
    powers = _powers(len(hashes))
    for i in range(0, len(hashes), 512):
        mixed = (hashes[i : i + 512] ^ _SEEDS[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        member = np.flatnonzero(mixed <= _LIMITS[:, None])
        subset = member // mixed.shape[1]
        counts = np.bincount(subset, minlength=len(_SEEDS))
        starts = np.cumsum(counts) - counts
        place = np.arange(len(member)) - starts[subset] + sizes[subset]
        products = np.concatenate([mixed.ravel()[member] * powers[place], np.zeros(1, np.uint64)])
        out += np.where(counts > 0, np.add.reduceat(products, starts), np.uint64(0))
        sizes += counts
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return np.where(sizes > 0, (out >> np.uint64(40)) % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the subsets that hold terms of either text, the share whose hashes are equal, over the levels at which terms
    are sparse: those from the last level on at which half the subsets hold some. 1 if all hashes are equal."""
    if (a == b).all():
        return 1.0
    some = ((a != 0) | (b != 0)).reshape(len(RATES), SUBSETS)
    same = ((a == b) & (a != 0)).reshape(len(RATES), SUBSETS)
    full = np.flatnonzero(some.sum(axis=1) * 2 >= SUBSETS)
    first = full[-1] if len(full) else 0
    return float(same[first:].sum() / max(1, some[first:].sum()))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points (or all) from the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class Prints:
    """Fingerprints of texts under one sorted lexicon, whose terms are numbered in their order."""

    def __init__(self, words: list[str], least: int = LEAST):
        self.number, self.least = {w: k for k, w in enumerate(words)}, least
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        own = terms(text)
        found = [n for n in map(self.number.get, own) if n is not None]
        if len(found) < self.least:
            return subset_hashes(np.array([xxhash.xxh64_intdigest(t) for t in sorted(own)], dtype=np.uint64))
        return subset_hashes(self.hashes[np.sort(np.array(found, dtype=np.int64))])


def fingerprints(documents: DataFrame, low: float = LOW, high: float = HIGH, least: int = LEAST) -> DataFrame:
    """doc_id, fingerprint of every text (a null one is empty): four hexadecimal digits for each subset.

    Equal texts have equal fingerprints. Repeated rows are kept, extra columns ignored; an empty table gives no rows.
    """
    words = documents.sparkSession.sparkContext.broadcast(lexicon(documents, low, high))
    out = schema(doc_id=LONG, fingerprint=STRING)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(words.value, least)
        for b in batches:
            found = [prints(t or "").tobytes().hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=out.names)

    return common.only(documents, "doc_id", "text").mapInArrow(fingerprint, out)


def with_edits(documents: DataFrame, low: float = LOW, high: float = HIGH, least: int = LEAST, rows_per_part: int = 3000) -> DataFrame:
    """Fingerprints of every text and of its edit (see `edited`), with the likeness of the two and that to the next
    document's, by ascending doc_id (null first; repeated ids by text; after the last comes the first). Null texts are
    empty ones. Texts of any length are read whole. Repeated rows are kept, extra columns ignored; an empty table gives no
    rows, and a single document is followed by itself.

    Documents are dealt out by ranges of doc_id. All but the last of each range find their follower there. A range's last
    document and the next range's first text meet by the range's number, two texts in a group. Both read one exchange.
    """
    common.batch_rows(documents.sparkSession, 500)
    words = documents.sparkSession.sparkContext.broadcast(lexicon(documents, low, high))
    docs = common.only(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    result = schema(doc_id=LONG, n_chars=LONG, edited_sha256=STRING, fingerprint=STRING, edited_fingerprint=STRING, near_edited=DOUBLE, near_next=DOUBLE)
    ends = schema(part=INT, doc_id=LONG, text=STRING, next_text=STRING)

    def row(prints: Prints, doc_id: int, text: str, own: np.ndarray, following: str, its: np.ndarray) -> dict:
        changed = edited(text, following)
        print_ = prints(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha, "fingerprint": own.tobytes().hex(), "edited_fingerprint": print_.tobytes().hex(), "near_edited": likeness(own, print_), "near_next": likeness(own, its)}

    def arrow(rows: list[dict], kind) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in kind.names} for r in rows], schema=to_arrow_schema(kind))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, last = Prints(words.value, least), None
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = prints(text)
                if last is not None:
                    rows.append(row(prints, *last, text, own))
                last = doc_id, text, own
            yield arrow(rows, result)

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1).to_pylist()[0]
                last = b.slice(b.num_rows - 1, 1)
        if first is not None:
            yield arrow([last.to_pylist()[0], {"part": first["part"] - 1, "next_text": first["text"]}], ends)

    dealt = common.in_order(docs, rows_per_part, "text")
    bounds = range_ends(dealt.mapInArrow(ends_of, ends))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(words.value, least)
        for b in batches:
            yield arrow([row(prints, r["doc_id"], r["text"], prints(r["text"]), r["next_text"], prints(r["next_text"])) for r in b.to_pylist()], result)

    return dealt.mapInArrow(walk, result).unionByName(bounds.mapInArrow(join_up, result))


def range_ends(sides: DataFrame) -> DataFrame:
    """doc_id, text, next_text of each range's last document and the first text of the range after it (after the last:
    the first) from rows (part, doc_id, text) of last documents and rows (part, next_text) of first texts, these under the
    part before theirs.

    They meet by part. Beside an empty range they don't, nor at the very ends: those rows are put in order in one
    task. They are four at most, since a range ends at a row's id, so none but the last range can be empty.
    """
    own = F.when(F.col("text").isNotNull(), F.struct("doc_id", "text"))
    pairs = sides.groupBy("part").agg(F.first(own, True).alias("last"), F.first("next_text", True).alias("next_text"))
    met = F.col("last").isNotNull() & F.col("next_text").isNotNull()
    lasts = F.collect_list(F.when(F.col("last").isNotNull(), F.struct("part", "last")))
    heads = F.array_sort(F.collect_list(F.when(F.col("next_text").isNotNull(), F.struct("part", "next_text"))))
    rest = pairs.where(~met).agg(lasts.alias("lasts"), heads.alias("heads")).select(F.explode("lasts").alias("l"), "heads")
    after = F.filter("heads", lambda h: h["part"] >= F.col("l.part"))
    follower = F.coalesce(F.get(after, F.lit(0)), F.get("heads", F.lit(0)))
    found = pairs.where(met).select("last.doc_id", "last.text", "next_text")
    return found.unionByName(rest.select("l.last.doc_id", "l.last.text", follower["next_text"].alias("next_text")))
