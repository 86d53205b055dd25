"""Line dedup: a suffix array over line-id sequences by prefix doubling, whose common-prefix intervals give the repeated
runs of lines; all but the first copy of a run are deleted.

A run counts if it has `least_words` words. Lines that occur once end every run, so only lines that occur twice or more
enter the array. Ranks are of blocks of 1, 2, 4, ... lines: each round ranks the pairs of two neighbouring blocks by one
sort of the distinct pairs. Blocks that occur once are dropped between rounds. Any run of up to twice a round's lines is
then named by the ranks of the two (overlapping) blocks at its ends: equal names are one interval of the array. The
smallest runs of enough words that start, and that end, at each line are compared, which covers all longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wayfold.llm import common
from wayfold.llm.common import INT, LONG, schema

LEAST_WORDS = 50
DOC = ["doc_id", "text_id"]


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_id, seq, line_no, words, h1, h2 of every line with a word; seq counts these within their text."""
    docs = common.only(documents, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    out = schema(doc_id=LONG, text_id=LONG, seq=INT, line_no=INT, words=INT, h1=LONG, h2=LONG)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text_id, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_id", "text"))):
                raw = [x.strip(b" \t\r\f\v") for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
                own = [(i, x) for i, x in enumerate(raw) if x]
                for seq, (i, x) in enumerate(own):
                    rows.append((doc_id, text_id, seq, i, len(x.split()), xxhash.xxh3_128_digest(x)))
            *columns, digests = zip(*rows) if rows else [[]] * 6
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)] + [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.mapInArrow(split, out)


def _ranks(keys: DataFrame, order: list[str]) -> DataFrame:
    """Distinct keys with a rank that ascends with them (not densely)."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())


def suffix_ranks(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines that repeat, with r0, r1, ...: the ranks of the blocks of 1, 2, 4, ... lines that start at each; null where
    such a block occurs once or isn't whole. Sorted by these ranks the rows are in the order of the suffix array, as
    deep as a run of least_words words can be long."""
    total = rows.count()
    twice = common.stash(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    ranked = common.stash(_ranks(twice, ["h1", "h2"]), "ranks")
    found = common.join_counted(rows, ranked, ["h1", "h2"], total)
    state = common.stash(found.select(*DOC, "seq", "line_no", "words", F.col("rank").alias("r0")), "array")
    common.drop(twice, ranked)
    total = state.count()
    k = 1
    while 2**k <= least_words:
        step, last = 2 ** (k - 1), f"r{k - 1}"
        along = W.partitionBy(*DOC).orderBy("seq")
        whole = F.lead("seq", step).over(along) == F.col("seq") + step
        paired = common.stash(
            state.withColumns({"a": F.when(whole, F.col(last)), "b": F.when(whole, F.lead(last, step).over(along))}), "array"
        )
        common.drop(state)
        both = "a is not null and b is not null"
        pairs = common.stash(paired.where(both).groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "keys")
        ranked = common.stash(_ranks(pairs, ["a", "b"]), "ranks")
        if ranked.isEmpty():
            state = paired.drop("a", "b")
            break
        with_both = common.join_counted(paired.where(both), ranked, ["a", "b"], total, "left").drop("n")
        without = paired.where(f"not ({both})").withColumn("rank", F.lit(None).cast("long"))
        state = common.stash(with_both.unionByName(without).drop("a", "b").withColumnRenamed("rank", f"r{k}"), "array")
        common.drop(paired, pairs, ranked)
        k += 1
    return state


RUN = T.StructType([*schema(doc_id=LONG, text_id=LONG, seq=INT, n_lines=INT, a=LONG, b=LONG).fields, T.StructField("line_nos", T.ArrayType(INT))])


def smallest_runs(ranks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The smallest runs of least_words words that start or end at each repeating line, with the ranks that name them."""
    levels = [c for c in ranks.columns if c[0] == "r" and c[1:].isdigit()]
    parts = F.array_sort(F.collect_list(F.struct("seq", "line_no", "words", *levels)))
    texts = ranks.groupBy(*DOC).agg(parts.alias("own"), F.sum("words").alias("n")).where(F.col("n") >= least_words).drop("n")

    def runs_of(own: list[dict]) -> Iterator[tuple]:
        seq, words = [x["seq"] for x in own], [x["words"] for x in own]
        names = [[x[c] for x in own] for c in levels]
        start, end, sizes = 0, 0, 0
        spans = set()
        for i in range(len(own)):  # smallest end for each start
            if end < i or (end > i and seq[end - 1] - seq[i] != end - 1 - i):
                end, sizes = i, 0
            while sizes < least_words and end < len(own) and (end == i or seq[end] == seq[end - 1] + 1):
                sizes += words[end]
                end += 1
            if sizes >= least_words:
                spans.add((i, end))
            sizes = sizes - words[i] if end > i else 0
        sizes = start = 0
        for j in range(len(own)):  # largest start for each end
            if j and seq[j] != seq[j - 1] + 1:
                start, sizes = j, 0
            sizes += words[j]
            while sizes - words[start] >= least_words:
                sizes -= words[start]
                start += 1
            if sizes >= least_words:
                spans.add((start, j + 1))
        for i, j in sorted(spans):
            level = (j - i).bit_length() - 1
            if level < len(levels):
                a, b = names[level][i], names[level][j - 2**level]
                if a is not None and b is not None:
                    yield seq[i], j - i, a, b, [x["line_no"] for x in own[i:j]]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for b in batches:
            rows = [(d, t, *run) for d, t, own in zip(*(b.column(c).to_pylist() for c in (*DOC, "own"))) for run in runs_of(own)]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=RUN.names)

    return texts.mapInArrow(find, RUN)


def later_copies(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_id, seq, n_lines, line_nos, first_doc_id: every smallest repeated run but the first of its kind, by
    doc_id, text hash and line. Null texts have no lines; null doc_ids come first."""
    common.batch_rows(documents.sparkSession, 500)
    rows = common.stash(lines(documents).distinct(), "lines")
    runs = common.stash(smallest_runs(suffix_ranks(rows, least_words), least_words), "runs")
    key = ["n_lines", "a", "b"]
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "text_id", "seq")
    firsts = runs.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    found = common.join_counted(runs, firsts, key, runs.count()).where(place > F.col("first"))
    return found.select(*DOC, "seq", "n_lines", "line_nos", F.when(F.col("first.d") > -(2**63), F.col("first.d")).alias("first_doc_id"))


def dedup_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row of documents with its text without later copies, plus n_removed, the number of lines deleted.

    Lines are compared without white space at their ends; lines without a word neither count nor break a run, and stay.
    A later copy is deleted even where it overlaps the first. Rows with equal doc_id and text are one text and fare
    alike. Null texts stay null and texts of any length are read whole; an empty table gives no rows. Extra columns are
    kept, but for one named n_removed, which is replaced.
    """
    copies = later_copies(documents, least_words)
    gone = copies.groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_list("line_nos"))).alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("text_id").alias("__t"), "__gone")
    on = documents["doc_id"].eqNullSafe(gone["__d"]) & (F.xxhash64(documents["text"]) == gone["__t"])
    split = F.split(documents["text"], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone["__gone"])
    text = F.when(gone["__gone"].isNull(), documents["text"]).when(F.size(stay) == 0, "").otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    )
    own = [text.alias(c) if c == "text" else documents[f"`{c}`"] for c in documents.columns if c != "n_removed"]
    return documents.join(gone, on, "left").select(*own, F.coalesce(F.size(gone["__gone"]), F.lit(0)).cast("long").alias("n_removed"))


def report(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of every document after dedup (a null text counts as empty)."""
    before = documents.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    done = dedup_lines(common.only(before, "doc_id", "text", "n_lines"), least_words)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The same for DuckDB: all windows of lines that are smallest for their start or end, by their whole text.
ORACLE_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM split),
lined AS (SELECT doc_id, line_no, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS line FROM raw),
w AS (SELECT *, len(regexp_split_to_array(line, ' +')) AS words,
        row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM lined WHERE line <> ''),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM w),
fore AS (SELECT a.doc_id, a.seq AS i, min(b.seq) AS j FROM c a JOIN c b
        ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.seq < a.seq + 50 AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 2),
back AS (SELECT b.doc_id, max(a.seq) AS i, b.seq AS j FROM c a JOIN c b
        ON a.doc_id = b.doc_id AND a.seq <= b.seq AND b.seq < a.seq + 50 AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 3),
spans AS (SELECT * FROM fore UNION SELECT * FROM back),
named AS (SELECT s.doc_id, s.i, s.j, md5(string_agg(c.line, chr(10) ORDER BY c.seq)) AS name
        FROM spans s JOIN c ON s.doc_id = c.doc_id AND c.seq BETWEEN s.i AND s.j GROUP BY 1, 2, 3),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT c.doc_id, c.line_no FROM later l JOIN c ON l.doc_id = c.doc_id AND c.seq BETWEEN l.i AND l.j),
stay AS (SELECT raw.doc_id, count(gone.line_no) AS n_removed,
        coalesce(string_agg(raw.line, chr(10) ORDER BY raw.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS text
        FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.line_no = gone.line_no GROUP BY 1)
SELECT stay.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
    n_removed, sha256(stay.text) AS text_sha256 FROM stay JOIN documents d ON d.doc_id = stay.doc_id
"""
