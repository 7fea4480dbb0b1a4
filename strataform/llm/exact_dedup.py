"""Exact deduplication by content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import cut


def squeeze(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def content_hash(sha256: Column) -> Column:
    """128 bits: the first half of the digest that is returned anyway."""
    return F.unhex(F.substring(sha256, 1, 32))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash, hot: int = 1000) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 and n_chars.

    Texts are equal if they are the same bytes after squeeze(). Map-side, the copies in a task become one row of its
    (hash, text) group, so a text that fills a third of the table shuffles as one row a task; as the text itself is in
    the grouping key, texts of one hash that differ never meet. The row with the most code points stays, then the
    one with the smallest id (of any type that sorts). A null text counts as empty; a null id loses every tie; rows
    that repeat an id each get a row (all with the same verdict); no rows give none. Other columns are ignored.

    Verdicts go back to the rows by a join on the hash. Groups with more than one in `hot` of all rows, of which there
    can't be more than `hot`, are broadcast, and their rows are then dealt out by id, so none fills a task.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), squeeze(F.col(text_col)).alias("_text"))
    hashed = own.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256)).withColumn("_hash", hash_of(F.col("text_sha256")))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("_best")
    classes = cut(
        hashed.groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best)
        .select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "group_size", F.col("_best.id").alias("keep_id"))
    )
    rows = classes.agg(F.sum("group_size")).first()[0] or 0
    many = F.col("group_size") > max(1, rows // hot)
    wide = F.broadcast(classes.filter(many).select("text_sha256", F.struct("group_size", "keep_id").alias("_wide")))
    each = hashed.select("doc_id", "n_chars", "text_sha256").join(wide, "text_sha256", "left")
    each = each.withColumn("_key", F.when(F.col("_wide").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("id "), F.xxhash64("doc_id").cast("string"))))
    narrow = classes.filter(~many).select(F.col("text_sha256").alias("_key"), F.struct("group_size", "keep_id").alias("_narrow"))
    found = each.join(narrow, "_key", "left").withColumn("_class", F.coalesce("_wide", "_narrow"))
    return found.select("doc_id", F.col("_class.keep_id").alias("keep_id"), F.col("_class.group_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_class.keep_id")).alias("kept"), "text_sha256", "n_chars")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM r
"""
