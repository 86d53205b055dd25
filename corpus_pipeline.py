"""A corpus pipeline: documents become packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import balance, common, line_runs, packing, similar, tokens, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer, learnt from the labels of doc_ids outside its held-out fold, doesn't reject. Rows
    are told apart by doc_id (null ones too) and text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = toxicity.score_documents(docs, labels).where("predicted = 1")
    verdicts = verdicts.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id")).distinct()
    same = docs["doc_id"].eqNullSafe(verdicts["__id"]) & (F.xxhash64(docs["text"]) == verdicts["__text_id"])
    return docs.join(verdicts, same, "left_anti").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which nothing is left go, n_chars follows."""
    done = line_runs.dedup_lines(common.only(docs, *COLUMNS))
    left = done.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return similar.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix has copies of them."""
    return balance.repeat(docs, balance.mix(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequences that they are packed into."""
    return packing.pack_documents(docs, tokens.default_path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the learnt scorer, the Newton iterations nor the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
