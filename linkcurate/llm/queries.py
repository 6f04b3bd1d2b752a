"""The queries of this subpackage over the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcurate.llm import decontaminate, hard_negatives, language, merkle, minhash, neighbours, packing, page_text, passages, personal_data, quality, token_counts, token_files
from linkcurate.llm.common import fresh_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared language is `lang`, the host `source`; pages, with markup and address, are in `page_languages`."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text", "lang", "source"), language.fit_text_model(docs))
    return found.select("doc_id", F.col("lang").alias("declared"), "language", F.round("posterior", 6).alias("posterior"), F.col("identified").alias("kept"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, the language its markup declares, its address suffix and its host."""
    pages = language.page_evidence(table(spark, sf_dir, "pages")).select("page_id", "text", "lang", "host")
    found = language.identify(pages, language.fit_text_model(pages, key="page_id"), host="host")
    return found.select("page_id", F.col("lang").alias("declared"), "language", F.round("posterior", 6).alias("posterior"), F.col("identified").alias("kept"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.repeated_passages(table(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    manifest = token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_files(manifest, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(hard_negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("v"))
    return hard_negatives.mine(whole, F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, page_languages, op2_token_counts, op3_minhash_duplicates, op4_page_text, op5_repeated_passages, op6_token_files, op7_personal_data, op8_neighbours, op9_decontamination, op10_best_fit_packing, op11_hard_negatives, op12_merkle_manifest, op13_quality)}
SQL: dict[str, str] = {"op9_decontamination": decontaminate.SQL_TWIN, "op11_hard_negatives": hard_negatives.SQL_TWIN, "op12_merkle_manifest": merkle.SQL_TWIN}
