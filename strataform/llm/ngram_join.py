"""Similarity join of documents on the Jaccard similarity of their word n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import cut, looked_up, text_slices
from strataform.llm.near import THRESHOLD, band_plan, near_classes, set_name, shingles, signatures

#: Hashes in a band, and the share of pairs at the threshold that must meet in a bucket.
ROWS, RECALL = 5, 0.9999


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links and n_ngrams of every document.

    Words end at ASCII white space; an n-gram is five words, or all words of a shorter text. copy_id: the smallest
    doc_id with the same n-gram set, n_copies the rows that have it. n_links: rows of other n-gram sets with a Jaccard
    similarity of at least the threshold, and n_copies less one. class_id: the smallest doc_id that links lead to.
    A null or blank text has no n-grams, no links and is a class of its own; rows that repeat an id are copies or
    links like others; no rows give none. Other columns are ignored.
    """
    bands = band_plan(threshold, recall, ROWS)
    own = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, to, texts in text_slices(batch, "text"):
                sizes, names, keys = signatures(texts, bands, ROWS)
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), names, pa.array(sizes), keys], ["doc_id", "key", "n", "bands"])

    def sets(batches):
        for batch in batches:
            rest, keys = batch.drop_columns(["text"]), batch.column("key").to_pylist()
            for at, to, texts in text_slices(batch, "text"):
                hashes, starts = shingles(texts)
                got = [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                out = rest.slice(at, to - at).append_column("shingles", pa.array([x.tobytes() for x in got], pa.binary()))
                yield out.filter(pa.array([set_name(x) == k for x, k in zip(got, keys[at:to])]))  # another row of that id may have another text

    sigs = cut(own.mapInArrow(sign, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, key binary, n int, bands array<bigint>"))
    firsts = sigs.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"))

    def fetch(blocks: DataFrame) -> DataFrame:
        wanted = blocks.join(firsts.select("key", "copy_id"), "key")
        return own.join(wanted, own.doc_id == wanted.copy_id).select(*blocks.columns, "text").mapInArrow(sets, blocks.schema.add("shingles", "binary"))

    near = near_classes(sigs.select("key", "n", "bands"), fetch, threshold)
    classes = firsts.join(near, "key", "left")
    lowest = classes.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("copy_id").alias("class_id"))
    classes = cut(classes.withColumn("component", F.coalesce("component", "key")).join(lowest, "component").select("key", "class_id", "copy_id", "n_copies", F.coalesce("links", F.lit(0)).alias("links")))
    return looked_up(sigs.select("doc_id", "key", "n"), classes, "key").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1).alias("n_links"), F.col("n").cast("long").alias("n_ngrams"),
    )
