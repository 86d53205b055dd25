"""Queries over the corpus tables, one for each operator, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import balance, chat, common, imatch, licences, line_runs, lloyd, mcd, negatives, packing, similar, token_store, tokens, toxicity, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(_table(spark, sf_dir, "documents"))


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.outliers(_table(spark, sf_dir, "documents"))


def op3_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix(_table(spark, sf_dir, "documents"))


def op4_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.known_licences(spark))


def licence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's lookup on documents of which every second is a whole licence, changed in case, marks and copyright lines."""
    return licences.scan(licences.variants(_table(spark, sf_dir, "documents")), licences.known_licences(spark))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.captures_of(pages), url_lists.entries_of(pages))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"), keep_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(_table(spark, sf_dir, "documents"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join(_table(spark, sf_dir, "documents"))


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.default_path("byte_bpe_50k.json")
    stored = token_store.encode_to_orc(_table(spark, sf_dir, "documents"), path, common.stash_path(spark, "tokens"))
    return token_store.token_index(stored)


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.codes_of(_table(spark, sf_dir, "embeddings"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.with_adverse(spark, _table(spark, sf_dir, "conversations"))
    return chat.digests(common.stash(chat.format_chats(chats), "chats"))


def queries() -> dict:
    found = [op1_imatch, op2_mcd_outliers, op3_entropy_balance, op4_licence_digests, op5_url_lists, op6_best_two_fit, op7_toxicity, op8_line_runs, op9_chosen_path, op10_orc_tokens]
    found += [op11_delta_lloyd, op12_norm_buckets, op13_chat_format, licence_variants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licence_digests": licences.oracle_sql(), "licence_variants": licences.oracle_sql(licences.VARIANTS_SQL), "op5_url_lists": url_lists.ORACLE_SQL, "op8_line_runs": line_runs.ORACLE_SQL,
        "op11_delta_lloyd": lloyd.oracle_sql(), "op12_norm_buckets": negatives.ORACLE_SQL, "op13_chat_format": chat.ORACLE_SQL,
    }
