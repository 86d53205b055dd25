"""The index of names over parts and their brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import name_index
from wayfold.plans import tables
from wayfold.plans.road import query


@query(
    """, m AS (SELECT p_name || ' ' || p_brand AS name, max(p_size) AS importance, arg_max(p_partkey, p_size::BIGINT * 100000000 - p_partkey) AS id FROM part GROUP BY 1),
    r AS (SELECT *, substr(lower(name), 1, size) AS prefix FROM (SELECT *, unnest(range(0, length(name) + 1)) AS size FROM m)),
    b AS (SELECT prefix, string_agg(name || ':' || importance || ':' || id, ',' ORDER BY k) AS best FROM
        (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY importance DESC, name) AS k FROM r) WHERE k <= 10 GROUP BY 1),
    e AS (SELECT prefix, count(*) AS n, min(lower(name)) AS low, max(lower(name)) AS high FROM r GROUP BY 1)
    SELECT prefix, n, best, substr(low, length(prefix) + 1, list_max(list_filter(range(0, length(low) + 1), lambda i: substr(low, 1, i) = substr(high, 1, i))) - length(prefix)) AS continuation
    FROM e JOIN b USING (prefix)"""
)
def name_prefixes(spark, d):
    """Every beginning of the parts' names with brand: the ten largest that go on from it, and what all have in common."""
    named = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"), F.col("p_size").alias("importance"))
    shown = F.transform("best", lambda b: F.concat_ws(":", b["name"], b["importance"].cast("string"), b["id"].cast("string")))
    return name_index.prefixes(named).select("prefix", "n", F.concat_ws(",", shown).alias("best"), "continuation")
