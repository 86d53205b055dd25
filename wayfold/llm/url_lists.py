"""Temporal list join: dated list entries become validity intervals, and each capture is judged by the entries that
were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.llm import common

#: Seconds of a time bucket, by which intervals and captures meet in an equality join.
BUCKET = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/:?#]*)", 2), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: still valid) from entries (pattern, action, listed_at).

    An entry holds until the next one of its pattern; 'unlist' entries end one and give no interval. Of entries with
    one pattern and time the last by action stands. Entries with nulls are left out.
    """
    rows = (
        common.only(entries, "pattern", "action", "listed_at")
        .na.drop()
        .groupBy(F.lower("pattern").alias("pattern"), F.col("listed_at").alias("valid_from"))
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("valid_from").over(W.partitionBy("pattern").orderBy("valid_from"))
    return rows.withColumn("valid_to", following).where("action <> 'unlist'")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with host, pattern, action, blocked: what the most specific entry active at
    fetched_at says, the pattern being the host or a parent domain of it; null pattern where none was active.

    A host's distinct times are judged once. Interval and capture meet in buckets of BUCKET seconds, so an entry is read
    only by captures near its time, however long its list is. Patterns that more than common.HOT of all questions ask for,
    such as top-level domains, are left out where the list doesn't name them, else their questions are dealt over shares
    of even size and their intervals sent to each. Captures without host or time are not blocked. Repeated rows are kept,
    extra columns ignored; without captures there are no rows, without entries nothing is blocked.
    """
    seen = common.only(captures, "page_id", "url", "fetched_at").withColumn("host", host_of(F.col("url")))
    dated = (F.col("host") != "") & F.col("fetched_at").isNotNull()
    key = ["host", "fetched_at"]
    asked = common.stash(seen.where(dated).groupBy(*key).agg(F.count("*").alias("n")), "asked")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    bucket = lambda at: F.floor(F.unix_seconds(at) / BUCKET)
    tried = asked.select(*key, bucket(F.col("fetched_at")).alias("bucket"), F.explode(parents).alias("pattern"))
    last = F.broadcast(asked.agg(F.max("fetched_at").alias("last")))  # one row
    valid = intervals(entries).join(last).where("valid_from <= last")
    until = F.least(F.coalesce("valid_to", "last"), "last")
    spread = valid.select(
        "pattern", "action", "valid_from", "valid_to", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(until))).alias("bucket")
    )
    questions, total = asked.agg(F.sum(F.size(labels)), F.sum("n")).first()
    busy = common.stash(busy_patterns(tried, valid, questions or 0), "busy")  # fewer than 1 / HOT rows
    shares = F.coalesce("shares", F.lit(1))
    dealt = (
        tried.join(F.broadcast(busy), "pattern", "left")
        .where("shares is null or listed")
        .withColumn("share", F.pmod(F.xxhash64(*key), shares).cast("int"))
    )
    sent = spread.join(F.broadcast(busy), "pattern", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    found = (
        dealt.drop("shares", "listed")
        .join(sent.drop("shares", "listed"), ["pattern", "bucket", "share"])
        .where(active)
        .groupBy(*key)
        .agg(F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("hit"))
    )
    judged = common.stash(asked.join(found, key, "left").select(*key, "n", "hit.pattern", "hit.action"), "judged")
    hits = common.join_counted(seen.where(dated), judged, key, total or 0, "left").drop("n")
    none = seen.where(~F.coalesce(dated, F.lit(False))).withColumns({"pattern": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    blocked = F.coalesce(F.col("action") == "block", F.lit(False))
    return hits.unionByName(none).select("page_id", "host", "fetched_at", "pattern", "action", blocked.alias("blocked"))


def busy_patterns(tried: DataFrame, valid: DataFrame, questions: int) -> DataFrame:
    """pattern, shares, listed of the patterns with more than common.HOT of all questions (their number is given): over
    how many shares of about that size they are dealt, and if the list names them at all."""
    size = max(1, int(questions * common.HOT))
    busy = tried.groupBy("pattern").agg(F.ceil(F.count("*") / size).cast("int").alias("shares")).where("shares > 1")
    names = valid.select(F.col("pattern").alias("name")).distinct()
    return busy.join(names, F.col("pattern") == F.col("name"), "left").select("pattern", "shares", F.col("name").isNotNull().alias("listed"))


def captures_of(pages: DataFrame) -> DataFrame:
    """pages have no fetch times; this gives each one by a rule: minutes of 2024, spread by page_id."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list by a rule over the MD5 of each host and parent domain seen in pages: about half of the hosts are
    blocked from some day on, some of them unlisted later, and some parent domains are blocked or allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    names = hosts.select(F.col("host").alias("pattern")).union(hosts.select(parent)).distinct()
    digit = lambda i, n: F.conv(F.substring(F.md5("pattern"), i, n), 16, 10).cast("long")
    start = F.lit(1704067200) + digit(2, 2) * 86400
    rows = names.select(
        "pattern",
        F.explode(
            F.array(
                F.when(digit(1, 1) < 8, F.struct(F.lit("block").alias("action"), start.alias("s"))),
                F.when(digit(1, 1) < 5, F.struct(F.lit("unlist").alias("action"), (start + (digit(4, 2) + 1) * 43200).alias("s"))),
                F.when(digit(1, 1) == 9, F.struct(F.lit("allow").alias("action"), start.alias("s"))),
            )
        ).alias("e"),
    )
    return rows.where("e is not null").select("pattern", "e.action", F.timestamp_seconds("e.s").alias("listed_at"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/:?#]*)', 2), '') AS host,
        to_timestamp(1704067200 + ((page_id * 7919) % 525600) * 60) AT TIME ZONE 'UTC' AS fetched_at FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
names AS (SELECT host AS pattern FROM hosts UNION SELECT regexp_replace(host, '^[^.]+\\.', '') FROM hosts),
d AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 1))::BIGINT AS a, 1704067200 + ('0x' || substr(md5(pattern), 2, 2))::BIGINT * 86400 AS s,
        ('0x' || substr(md5(pattern), 4, 2))::BIGINT AS b FROM names),
e AS (SELECT pattern, 'block' AS action, s FROM d WHERE a < 8 UNION ALL SELECT pattern, 'unlist', s + (b + 1) * 43200 FROM d WHERE a < 5
      UNION ALL SELECT pattern, 'allow', s FROM d WHERE a = 9),
i AS (SELECT pattern, action, to_timestamp(s) AT TIME ZONE 'UTC' AS valid_from,
        to_timestamp(lead(s) OVER (PARTITION BY pattern ORDER BY s)) AT TIME ZONE 'UTC' AS valid_to FROM e),
hit AS (SELECT p.page_id, i.pattern, i.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.pattern) DESC) AS k
        FROM p JOIN i ON (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern))
        AND i.action <> 'unlist' AND p.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to))
SELECT p.page_id, p.host, p.fetched_at, hit.pattern, hit.action, coalesce(hit.action = 'block', false) AS blocked
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND hit.k = 1
"""
