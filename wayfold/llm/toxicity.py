"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding makes lower case, strips accents' look-alikes from other alphabets and digits within words to Latin letters, and
puts single spaces between words. The lexicon's entries are words (" word ") and beginnings of words (" begi"), each
weighted by its log odds among labelled texts. A logistic law turns the sum of weights, by length, into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import common
from wayfold.llm.common import DOUBLE, INT, LONG, STRING, schema

# Letters of other alphabets that look like Latin ones, and the Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ѡ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ſ": "s",
}
# Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "white trash bag", "clown fish", "class clown",
    "circus clown", "idiot proof", "pond scum", "soap scum", "sore loser", "garbage can", "garbage truck", "garbage collection", "garbage collector",
    "garbage disposal", "pig farm", "guinea pig", "guinea pigs", "pig iron", "rat race", "lab rat", "lab rats", "pack rat", "moron test", "dumb bell",
    "dumb waiter", "stupid question", "stupid questions", "crash test dummy", "dummy variable", "dummy load", "hate crime", "hate speech", "dirty laundry",
    "sick leave", "sick day", "sick days", "killer whale", "killer whales", "time killer", "weed killer", "dead end", "dead line", "dead sea", "ugly duckling",
)

#: Log odds that an entry needs; entries of the lexicon beyond which fit raises, since it goes to every task.
LEAST_ODDS, MOST_ENTRIES = 2.5, 1_000_000
#: Lengths of beginnings of words that may be entries.
STARTS = range(4, 9)
#: Labelled texts that the logistic law is fitted to, about, at most: those of hashes under this share of all.
FITTED = 20_000

_TABLE = str.maketrans({**HOMOGLYPHS, **{k.upper(): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}})
_WORD = re.compile(r"(?:(?<!\S)[@$])?[^\W_]+(?:[@$!][^\W_]+)*")
_MIXED = re.compile(r"(?=\S*[^\W\d_])\S*[\d@$!]\S*")
_DIGITS = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """' word word ... ': the folded words of a text. Digits change only in words that have letters too."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_TABLE)
    out = " " + " ".join(_WORD.findall(low)) + " "
    if re.search(r"[\d@$!]", out):
        out = _MIXED.sub(lambda m: m[0].translate(_DIGITS), out)
    return out


def entries_in(folded: str) -> set[str]:
    """Everything in a folded text that could be an entry."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for w in words:
        found.update(" " + w[:k] for k in STARTS if k <= len(w))
    return found


def lexicon(train: DataFrame) -> dict[str, float]:
    """Entries and weights (log odds, halved counts added) from train (text, toxic).

    An entry needs odds of LEAST_ODDS and a likelihood ratio that chance gives to about one of all candidates, so the
    rule adjusts itself to the number of texts and words. All that pass are kept, except that of entries that begin alike
    the surer one stands, of equally sure ones the longer. The counts cover every row. Raises beyond MOST_ENTRIES.
    """
    out = schema(entry=STRING, toxic=LONG, n=LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([bad[k] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=out.names
            )
            seen.clear()
            bad.clear()
            return batch

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = entries_in(fold(text or ""))
                seen.update(found)
                if toxic:
                    bad.update(found)
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    train = train.where(F.col("toxic").isNotNull())
    totals = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(totals["bad"] or 0), int(totals["n"]) - int(totals["bad"] or 0)
    if not bad or not good:
        return {}
    counts = train.select("text", "toxic").mapInArrow(count, out).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (good + 1))
    sure = odds * F.sqrt("toxic")
    share = bad / (bad + good)
    term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    rest = F.col("n") - F.col("toxic")
    ratio = 2 * (term(F.col("toxic"), F.col("n") * share) + term(rest, F.col("n") * (1 - share)))
    counts = common.stash(counts.select("entry", odds.alias("odds"), sure.alias("sure"), ratio.alias("ratio")), "tox-entries")
    passed = counts.where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= 2 * math.log(max(counts.count(), 2))))
    if passed.count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} lexicon entries pass; raise LEAST_ODDS")
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for r in sorted(passed.collect(), key=lambda r: (-r["sure"], -len(r["entry"]), r["entry"])):
        entry = r["entry"]
        if entry not in begun and not any(entry[:k] in kept for k in range(1, len(entry) + 1)):
            kept[entry] = float(r["odds"])
            begun.update(entry.rstrip()[:k] for k in range(1, len(entry.rstrip()) + 1))
    common.drop(counts)
    return kept


def automaton(words: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in words.items():
        found.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        found.add_word(fold(phrase), (len(fold(phrase)), None))
    found.make_automaton()
    return found


def weigh(matcher, text: str) -> tuple[float, int, int]:
    """Sum of the weights of entries in a text, how many there are, and its words. Of entries that start at one place
    the weightiest counts; entries within an exception phrase don't."""
    folded = fold(text)
    starts: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    if len(matcher):
        for end, (length, weight) in matcher.iter(folded):
            at = end - length + 1
            if weight is None:
                free.append((at, end))
            else:
                starts[at] = max(weight, starts.get(at, weight))
    if free:
        starts = {at: w for at, w in starts.items() if not any(a <= at < b for a, b in free)}
    return sum(starts.values()), len(starts), folded.count(" ") - 1 if folded.strip() else 0


def features(matcher, text: str) -> list[float]:
    weight, hits, words = weigh(matcher, text)
    return [1.0, math.log1p(weight), math.log1p(100 * weight / max(words, 1)), float(hits > 0), math.log1p(words)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients by Newton steps with a ridge on all but the first."""
    coef, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ coef)
        coef += step
        if np.abs(step).max() < 1e-8:
            break
    return coef


class Model:
    def __init__(self, words: dict[str, float], coef: np.ndarray, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.words, self.coef, self.exceptions = words, coef, exceptions


def fit(documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from labelled documents: the lexicon from all of them, the logistic law from FITTED at most.

    Labels of doc_ids without a document, null labels and null ids are left out. Without labels of both kinds every
    score is 0.
    """
    marks = common.only(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = common.only(documents, "doc_id", "text").hint("merge").join(marks, "doc_id")
    train = common.stash(train.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("long").alias("toxic")), "tox-train")
    words = lexicon(train)
    out = schema(toxic=LONG, **{f"x{i}": DOUBLE for i in range(5)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(words, exceptions)
        for b in batches:
            x = np.array([features(matcher, t) for t in b.column("text").to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, i]) for i in range(5))], names=out.names)

    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, train.count()))) < FITTED)
    rows = np.array([list(r) for r in chosen.select("text", "toxic").mapInArrow(measure, out).collect()], dtype=float)
    if not words or not len(rows):
        return Model({}, np.array([-50.0, 0, 0, 0, 0]), exceptions)
    return Model(words, logistic(rows[:, 1:], rows[:, 0]), exceptions)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_id (hash of the text), score, predicted, weight, hits, n_words of every text; null ones score as empty.

    Only the text counts, the whole of it however long. Equal texts have equal scores. Repeated rows and null ids are
    kept, extra columns ignored; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = schema(doc_id=LONG, text_id=LONG, score=DOUBLE, predicted=INT, weight=DOUBLE, hits=LONG, n_words=LONG)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        matcher = automaton(known.words, known.exceptions)
        for b in batches:
            found = [weigh(matcher, t or "") for t in b.column("text").to_pylist()]
            x = np.array([[1.0, math.log1p(w), math.log1p(100 * w / max(n, 1)), float(h > 0), math.log1p(n)] for w, h, n in found]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ known.coef, -50, 50)))
            columns = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            columns += [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_id"), *columns], names=out.names)

    docs = common.only(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return docs.mapInArrow(judge, out)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labels that aren't held out, applied to every document."""
    common.batch_rows(documents.sparkSession, 1000)
    model = fit(documents, labels.where(~held_out(F.col("doc_id"))))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "weight", "hits", "n_words", "text_id")
