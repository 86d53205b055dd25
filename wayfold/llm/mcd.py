"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

A group's estimate is the mean and covariance of those H of its rows whose covariance has the least determinant. As in
the published fast algorithms, several deterministic starts (scatters of tanh scores, of ranks, of spatial signs, and of
the half nearest to the medians) are brought to convergence by C-steps on a bounded sample of the group, and the best of
them go on with C-steps over all its rows until the determinant falls no more. A C-step takes the nearest H of all rows
by Mahalanobis distance and estimates anew, which never raises the determinant. These steps are aggregates over a narrow
table of features, so a group of any size is spread over all tasks.

Cutoffs are those of Hardin and Rocke: quantiles of a scaled F law, whose degrees of freedom grow with the group.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wayfold.llm import common
from wayfold.llm.common import LONG, schema

SYMBOLS = "#*$%&|<>"
#: Share of rows that an estimate rests on, and share of normal rows that the cutoff keeps.
H, LEVEL = 0.75, 0.9999
#: Number of features; rows that a group needs to have an estimate of its own: five a feature.
P, LEAST_ROWS = 5, 25
#: Rows of a group that starts are sought on, at most; starts that go on to all rows; C-steps until an error is raised.
START_ROWS, STARTS, STEPS = 1000, 2, 60
#: Words and characters a word that means and shares are smoothed by, as if each text had so many more ordinary words: a
#: short text's mean is uncertain. A fifth of a mark a word goes with them.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_MARKS = 50, 5.0, 0.2
#: What is added to variances, as a share of those over all rows: matters for singular matrices alone.
RIDGE = 1e-4

_STATS = schema(n_words=LONG, word_chars=LONG, n_symbols=LONG, n_dup_lines=LONG, n_repeat_words=LONG, n_lines=LONG, n_marks=LONG, n_distinct=LONG)
_LETTERS = re.compile(r"[^\W_]+")


def text_statistics(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks (characters of words that are neither
    letters nor digits), n_distinct (distinct words) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = len(raw) - sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()] if "\n" in text else [text] * (n > 0)
    dup = len(lines) - len(set(lines))
    distinct = len(set(words))
    repeated = 0
    if n > 3 and distinct < n:
        windows = list(zip(words, words[1:], words[2:]))
        twice = {w for w, k in Counter(windows).items() if k > 1}
        if twice:
            inside = np.zeros(n, dtype=bool)
            at = np.flatnonzero(np.fromiter((w in twice for w in windows), dtype=bool, count=n - 2))
            for k in range(3):
                inside[at + k] = True
            repeated = int(inside.sum())
    return n, len(text) - blanks, symbols, dup, repeated, len(lines), len(_LETTERS.sub("", text)) - blanks, distinct


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every text; a null text has no words."""
    out = schema(doc_id=LONG, lang=T.StringType(), source=T.StringType())
    for f in _STATS.fields:
        out = out.add(f)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_statistics(t or "") for t in b.column("text").to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * len(_STATS.names))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *columns], names=out.names)

    return common.only(documents, "doc_id", "lang", "source", "text").mapInArrow(measure, out)


def features() -> list[Column]:
    """The transformed statistics: logarithms of length, mean word length, share of marks, words a line and distinct
    words. All vary in ordinary texts, and are related: distinct words and marks go with length, so their covariance
    tells a text of few distinct words from a short one."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(n.cast("double")),
        F.log((chars + PRIOR_WORDS * PRIOR_CHARS) / (n + PRIOR_WORDS)),
        F.log((F.col("n_marks") + 1 + PRIOR_WORDS * PRIOR_MARKS) / (F.col("word_chars") + 1 + PRIOR_WORDS * PRIOR_CHARS)),
        F.log(n / F.greatest("n_lines", F.lit(1))),
        F.log(F.greatest("n_distinct", F.lit(1)).cast("double")),
    ]


def chi2_cdf(x: float, k: float) -> float:
    """Lower regularised gamma function at (k / 2, x / 2), by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if z > 0 else 0.0


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    value, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            part = 1.0
        elif i % 2 == 0:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + part * d)
        c = 1 + part / c
        value *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    power = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(power) / a * (value - 1)


def quantile(cdf, p: float) -> float:
    low, high = 0.0, 10.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def kept_rows(n: int) -> int:
    """Rows that the estimate of a group of n rows rests on."""
    return math.ceil(H * n)


def consistency(n: int, p: int = P) -> float:
    """What makes the covariance of the nearest H rows that of all rows, for normal vectors."""
    share = min(kept_rows(n) / n, 1 - 1e-12)
    return share / chi2_cdf(quantile(lambda x: chi2_cdf(x, p), share), p + 2)


def freedom(n: int, p: int = P) -> float:
    """Degrees of freedom of the Wishart law nearest to the estimate's: the asymptotic ones by Croux and Haesbroeck, with
    the correction of Hardin and Rocke for small n."""
    a = min(max((n - kept_rows(n)) / n, 1e-9), 0.5)
    q = quantile(lambda x: chi2_cdf(x, p), 1 - a)
    c = (1 - a) / chi2_cdf(q, p + 2)
    c2, c3 = -chi2_cdf(q, p + 2) / 2, -chi2_cdf(q, p + 4) / 2
    b1 = -2 * c * c3 / (1 - a)
    b2 = 0.5 + c / (1 - a) * (c3 - q / p * (c2 + (1 - a) / 2))
    v1 = (1 - a) * b1**2 * (a * (c * q / p - 1) ** 2 - 1) - 2 * c3 * c**2 * (3 * (b1 - p * b2) ** 2 + (p + 2) * b2 * (2 * b1 - p * b2))
    v2 = n * (b1 * (b1 - p * b2) * (1 - a)) ** 2 * c**2
    return 2 * v2 / (c * c * v1) * math.exp(0.725 - 0.00663 * p - 0.0780 * math.log(n))


@lru_cache(maxsize=100_000)
def cutoff(n: int, p: int = P, level: float = LEVEL) -> float:
    """Squared distance up to which rows are kept under the estimate of a group of n rows."""
    m = max(freedom(n, p), p + 1.5)
    b = m - p + 1
    return p * m / b * quantile(lambda x: beta_cdf(p * x / (p * x + b), p / 2, b / 2), level)


def squared_distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    off = x - centre
    return np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)


def least_determinants(x: np.ndarray, ridge: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log determinant, centre, covariance) reached from each start by C-steps on the rows of x, the least first."""
    n, p = x.shape
    h = kept_rows(n)
    medians = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - medians), axis=0)
    spread = np.where(spread > 0, spread, np.sqrt(np.var(x, axis=0) + ridge))
    z, small = (x - medians) / spread, np.diag(ridge / spread**2)
    norms = np.sqrt((z**2).sum(axis=1))
    signs = z / np.maximum(norms, 1e-12)[:, None]
    half = z[np.argsort(norms, kind="stable")[: max(n // 2, min(n, p + 1))]]
    ranks = np.argsort(np.argsort(z, axis=0, kind="stable"), axis=0, kind="stable").astype(float)
    scatters = [np.cov(np.tanh(z).T, bias=True), np.cov(ranks.T, bias=True) / n**2, signs.T @ signs / n, np.cov(half.T, bias=True)]
    found = []
    for scatter in scatters:
        axes = np.linalg.eigh(scatter + 1e-9 * np.eye(p))[1]
        along = z @ axes
        width = np.maximum(1.4826 * np.median(np.abs(along - np.median(along, axis=0)), axis=0), np.sqrt(np.diag(axes.T @ small @ axes)))
        round_ = along / width
        near = np.argsort(((round_ - np.median(round_, axis=0)) ** 2).sum(axis=1), kind="stable")[:h]
        least, centre, cov = np.inf, None, None
        while True:
            mean = z[near].mean(axis=0)
            own = np.cov(z[near].T, bias=True) + small
            log_det = np.linalg.slogdet(own)[1]
            if log_det >= least - 1e-10:
                break
            least, centre, cov = log_det, mean, own
            near = np.argsort(squared_distances(z, centre, cov), kind="stable")[:h]
        found.append((least + 2 * np.log(spread).sum(), centre * spread + medians, cov * np.outer(spread, spread)))
    return sorted(found, key=lambda f: f[0])


_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MODEL = [*(f"m{i}" for i in range(P)), *(f"p{i}{j}" for i, j in _PAIRS)]
_MODEL_TYPES = ", ".join(["gid long", "start int", "n long", "done boolean", "log_det double", *(f"{c} double" for c in _MODEL)])


def _model_row(gid: int, start: int, n: int, done: bool, log_det: float, centre: np.ndarray, cov: np.ndarray) -> list:
    inverse = np.linalg.inv(cov)
    return [gid, start, n, done, log_det, *centre, *(inverse[i, j] for i, j in _PAIRS)]


def _grouped(stats: DataFrame) -> DataFrame:
    """stats with gid and pool (0: a group's own rows, 1: its language's small groups, 2: those of all other languages).

    Groups with fewer than LEAST_ROWS rows that pass the base rules are pooled by language, then altogether; both are null
    where even all of those are too few."""
    good = F.sum((~F.col("base_failed")).cast("long"))
    sizes = stats.groupBy("lang", "source").agg(good.alias("n"))
    small = F.col("n") < LEAST_ROWS
    by_lang = sizes.where(small).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    named = common.null_safe(sizes, by_lang, ["lang"], "left").withColumn("level", F.when(~small, 0).when(F.col("n_lang") >= LEAST_ROWS, 1).otherwise(2))
    rest = named.where("level = 2").agg(F.sum("n")).first()[0] or 0
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    gid = F.xxhash64("level", F.when(F.col("level") < 2, text("lang")), F.when(F.col("level") < 1, text("source")))
    known = (F.col("level") < 2) | F.lit(rest >= LEAST_ROWS)
    named = named.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.when(known, gid).alias("gid"), F.when(known, F.col("level")).alias("pool"))
    named = common.stash(named, "mcd-groups")
    same = F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))
    return stats.join(common.small(named), same).drop("__l", "__s")


def _first_models(good: DataFrame, ridge: np.ndarray) -> DataFrame:
    """The STARTS best models of each group, from at most START_ROWS of its rows, chosen by hash."""
    order = F.xxhash64("doc_id", *_X)
    sizes = common.stash(good.groupBy("gid").agg(F.count("*").alias("n")), "mcd-sizes")
    sample = (
        good.join(common.small(sizes), "gid")
        .where(F.pmod(order, F.col("n")) < 2 * START_ROWS)
        .withColumn("k", F.row_number().over(W.partitionBy("gid").orderBy(order, *_X)))
        .where(F.col("k") <= START_ROWS)
    )

    def seek(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("k")
        gid, n = int(table["gid"].iloc[0]), int(table["n"].iloc[0])
        found = least_determinants(table[_X].to_numpy(dtype=float), ridge)[:STARTS]
        # A start's determinant is that of a sample, so the first step over all rows always counts as an improvement.
        return pd.DataFrame([_model_row(gid, k, n, False, math.inf, c, s) for k, (_, c, s) in enumerate(found)], columns=["gid", "start", "n", "done", "log_det", *_MODEL])

    return sample.select("gid", "n", "k", *_X).groupBy("gid").applyInPandas(seek, _MODEL_TYPES)


def _distance() -> Column:
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    return sum((d[i] * d[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _stepped(models: DataFrame, moments: DataFrame, ridge: np.ndarray) -> DataFrame:
    """models after a C-step: `done` where the determinant fell no more, else the estimate from the moments of the kept
    rows (about the old centre)."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in batches:
            rows = []
            for r in table.to_dict("records"):
                off = np.array([r[f"s{i}"] for i in range(P)]) / r["kept"]
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["kept"] - off[i] * off[j]
                cov += np.diag(ridge)
                log_det = float(np.linalg.slogdet(cov)[1])
                if log_det >= r["log_det"] - 1e-6:
                    rows.append([r["gid"], r["start"], r["n"], True, r["log_det"], *(r[c] for c in _MODEL)])
                else:
                    rows.append(_model_row(r["gid"], r["start"], r["n"], False, log_det, off + [r[f"m{i}"] for i in range(P)], cov))
            yield pd.DataFrame(rows, columns=["gid", "start", "n", "done", "log_det", *_MODEL])

    return models.join(moments, ["gid", "start"]).mapInPandas(step, _MODEL_TYPES)


def estimates(good: DataFrame) -> DataFrame:
    """gid, n, log_det and the model (centre m0.., inverse covariance p00..) of each group of good (doc_id, gid, x0..).

    The nearest H are found by a quantile of the distances, exact up to 5000 rows and within 1 in 10,000 of the rank
    beyond. Raises if some group's determinant still falls after STEPS steps.
    """
    spreads = good.agg(*[F.var_pop(x).alias(x) for x in _X]).first()
    ridge = np.array([RIDGE * (spreads[x] or 0.0) + 1e-12 for x in _X])
    models = common.stash(_first_models(good, ridge), "mcd")
    finished = None
    for _ in range(STEPS):
        far = good.join(common.small(models), "gid").withColumn("d2", _distance())
        key = ["gid", "start"]
        near = common.stash(far.groupBy(*key).agg(F.percentile_approx("d2", H, 10_000).alias("most")), "mcd")
        d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
        moments = far.join(common.small(near), key).where("d2 <= most").groupBy(*key).agg(
            F.count("*").alias("kept"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"q{i}{j}") for i, j in _PAIRS]
        )
        stepped = common.stash(_stepped(models, moments, ridge), "mcd")
        common.drop(models, near)
        ended = stepped.where("done")
        finished = ended if finished is None else finished.unionByName(ended)
        models = common.stash(stepped.where("not done"), "mcd")
        if models.isEmpty():
            best = finished.withColumn("k", F.row_number().over(W.partitionBy("gid").orderBy("log_det", "start")))
            return common.stash(best.where("k = 1").select("gid", "n", "log_det", *_MODEL), "mcd")
    raise RuntimeError(f"the determinant of a group still falls after {STEPS} steps")


def outliers(documents: DataFrame) -> DataFrame:
    """Statistics of every text, base_failed, its squared Mahalanobis distance, the cutoff, and whether it is kept.

    Estimates rest on the rows that pass the base rules. Null languages and sources are groups of their own. A group
    with fewer than LEAST_ROWS such rows is pooled with the others of its language, and those of languages with too few
    altogether; if those are too few as well they have no estimate, and base rules alone decide. Null and empty texts
    have no words and fail the base rules. `pool` and `pool_rows` tell which rows, and how many, a row's estimate rests on;
    of the fewer they are the wider the cutoff is, so that of normal rows the same share is kept at any size. Texts are measured whole, whatever their length. Repeated rows count as often
    as they occur; an empty table gives no rows; extra columns are ignored.
    """
    common.batch_rows(documents.sparkSession, 1000)
    stats = statistics(documents).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    stats = common.stash(stats.withColumns({x: v.cast("double") for x, v in zip(_X, features())}), "mcd-stats")
    grouped = common.stash(_grouped(stats), "mcd-grouped")
    models = estimates(grouped.where("not base_failed and gid is not null").select("doc_id", "gid", *_X))

    def with_cutoff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in batches:
            n = [int(k) for k in table["n"]]
            yield table.assign(cutoff=[cutoff(k) for k in n], factor=[consistency(k) for k in n]).drop(columns=["log_det"]).rename(columns={"n": "pool_rows"})

    types = ", ".join(["gid long", "pool_rows long", *(f"{c} double" for c in _MODEL), "cutoff double", "factor double"])
    limits = common.stash(models.mapInPandas(with_cutoff, types), "mcd-limits")
    judged = grouped.join(common.small(limits), "gid", "left").withColumn("distance2", _distance() / F.col("factor"))
    return judged.select(
        "doc_id", "lang", "source", *_STATS.names, "base_failed", "pool", "pool_rows", "distance2", "cutoff",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.col("cutoff"), F.lit(True))).alias("kept"),
    )
