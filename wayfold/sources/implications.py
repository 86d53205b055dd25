"""Tags that imply others, read from SQLite files of wiki pages by a data source of its own."""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from wayfold.operators import places

#: Columns of the pages, by the names that the files have.
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "key", "value", "tags_implies")])
#: Pages a task reads, and rows a batch.
PAGES, BATCH = 50_000, 8192


@dataclass
class Rows(InputPartition):
    """Pages of a file by their row numbers, first to last."""

    path: str
    first: int
    last: int


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], pages: int) -> None:
        self.paths, self.pages, self.where, self.values = paths, pages, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of one column with one value or several go into the statement as parameters; Spark does the others."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            known = values is not None and len(f.attribute) == 1 and f.attribute[0] in SCHEMA.names
            # SQLite takes no more than 999 parameters in its older builds.
            if known and len(self.values) + len(values) <= 900 and all(isinstance(v, str) for v in values):
                self.where.append(f"\"{f.attribute[0]}\" IN ({', '.join('?' * len(values))})" if values else "0")
                self.values += values
            else:
                yield f

    def partitions(self) -> list[Rows]:
        found = []
        for path in self.paths:
            with closing(_open(path)) as db:
                low, high = db.execute("SELECT min(rowid), max(rowid) FROM wikipages").fetchone()
            if low is not None:
                found += [Rows(path, k, min(k + self.pages - 1, high)) for k in range(low, high + 1, self.pages)]
        return found

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(f'CAST("{c}" AS TEXT)' for c in SCHEMA.names)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        with closing(_open(partition.path)) as db:
            rows = db.execute(f"SELECT {columns} FROM wikipages WHERE {where}", [partition.first, partition.last, *self.values])
            while batch := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*batch)], names=SCHEMA.names)


class WikiPages(DataSource):
    """Table wikipages of the SQLite files at `path` (a pattern), which all executors must be able to open by that path; option
    `pages` sets how many a task reads. There is no partition for an empty table."""

    @classmethod
    def name(cls) -> str:
        return "wikipages"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(f"no file at {self.options['path']}")
        return _Reader(paths, int(self.options.get("pages", PAGES)))


def pages(spark: SparkSession, path: str, per_task: int = PAGES) -> DataFrame:
    """lang, key, value, tags_implies of the pages. Lets the session push filters to sources in Python, so one on the language
    is SQLite's."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WikiPages)
    return spark.read.format("wikipages").option("pages", str(per_task)).load(path)


def implied(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """key, value, implied_key, implied_value of the pages in a language, from lists such as 'oneway=yes,layer=1'.

    A null value (a page on a key) is the empty one. Items that aren't one key and one value, neither empty, are left out, and so
    are all values of an implied key for which pages of a tag give several, whatever stands between them in order.
    """
    found = pages(spark, path).where((F.col("lang") == lang) & (F.col("tags_implies") != ""))
    rows = found.select("key", F.coalesce("value", F.lit("")).alias("value"), F.col("tags_implies").alias("implies"))
    return places.implications(rows).where("implied_key <> '' and implied_value <> ''")
