"""From raw documents to packed training sequences, stage by stage.

Each stage works on what the one before it kept, and returns the columns of documents (the last one: pieces and their
places in sequences). A stage is written as Parquet and read again before the next begins.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import exact_dedup, language_id, ngram_join, packing, suffix_dedup
from strataform.llm._shared import cut

#: The columns that stages read.
DOCUMENTS = ("doc_id", "text", "lang", "n_chars")


def _named(stage):
    """The stage over columns that have plain names meanwhile, all but those of documents: any name passes through."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = docs.toDF(*(x if x in DOCUMENTS else f"_{k}" for k, x in enumerate(docs.columns)))
        return stage(spark, own, sf_dir).select(*own.columns).toDF(*docs.columns)

    return run


@_named
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter, with an empty or null text go.

    A row with a null doc_id or lang is judged like others, but teaches nothing; repeated rows stay as often as they
    come. Of languages as near, the first by name counts, so ties don't reject. A very long text is judged whole.
    """
    return language_id.identified(docs)


def _one_each(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """Of the rows whose key is in stay one for each key: that with the longest text, then the first by its text and other columns."""
    rest = F.struct(*(x for x in docs.columns if x != "text")).alias("rest")
    own = docs.select(key.alias("_key"), F.struct((-F.char_length("text")).alias("n"), "text", rest).alias("_row"))
    one = own.join(stay.distinct(), "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row"))
    return one.select(*(F.col("_row.text" if x == "text" else f"_row.rest.`{x}`").alias(x) for x in docs.columns))


@_named
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the one with the smallest doc_id; one row of each group, with a null doc_id only if no other is as long. Rows that repeat a doc_id are rows like others; of repeated rows the first by their columns stays. Null and empty texts are one group; no rows give none; other columns pass through, whatever they are called."""
    key = lambda sha: F.struct(sha.alias("sha"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    stay = exact_dedup.exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("_key"))
    return _one_each(docs, key(F.sha2(exact_dedup.squeeze(F.col("text")).cast("binary"), 256)), stay)


@_named
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar n-gram sets link, the one with the smallest doc_id stays; one row of each group, with a null doc_id only if all are null. Rows that repeat a doc_id are told apart by their text, and of equal ones the first by their columns stays. Texts without a word are a group each by doc_id; no rows give none; other columns pass through, whatever they are called. A text of any length is compared whole."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text"))
    stay = ngram_join.ngram_join(docs.select(key.alias("_key"), "text"), id_col="_key").filter("doc_id = class_id").select(F.col("doc_id").alias("_key"))
    return _one_each(docs, key, stay)


@_named
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out; a document of which nothing is left goes.

    A row with a null doc_id is neither cut nor compared, and goes only if its text is null or empty. Rows of one
    doc_id aren't earlier than each other, so repeated rows stay. Texts under 50 bytes stay; n_chars counts what is
    left; other columns pass through, whatever they are called; no rows give none.
    """
    rest = tuple(x for x in docs.columns if x not in ("text", "n_chars"))
    left = suffix_dedup.remove_repeats(docs, whole_characters=True, carry=rest).filter(F.octet_length("kept") > 0)
    text = F.decode("kept", "utf-8")
    return left.select("rest.*", text.alias("text"), F.char_length(text).cast("long").alias("n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    A null or empty text is a piece of the end token alone; rows that repeat a doc_id, or have none, are packed each; a
    text of any length is cut into pieces; other columns are left out; no rows give none.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", languages), ("exact_dedup", copies), ("ngram_join", near_copies), ("suffix_dedup", repeats), ("best_fit_packing", pack)]
#: The stages' profiles, signatures and packing plan can't be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
