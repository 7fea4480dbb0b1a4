"""The queries of this subpackage over the tables of a folder, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import ann, bpe, exact_dedup, importance, language_id, ngram_join, packing, paragraph_dedup, periodic_runs, pitman_yor, sanitisation, suffix_dedup, url_filter
from strataform.llm._shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.digests(table(spark, sf_dir, "documents"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitisation.digests(spread(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_url_filter, op4_best_fit_packing, op5_nearest_neighbours, op6_language_id, op7_byte_bpe, op8_paragraph_dedup, op9_pitman_yor, op10_ngram_join, op11_personal_data, op12_importance_resampling, op13_periodic_runs)}
ORACLE = {"op1_exact_dedup": exact_dedup.ORACLE, "op12_importance_resampling": importance.ORACLE}
