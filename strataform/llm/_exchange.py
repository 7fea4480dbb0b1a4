"""Packed exchanges between chunks of documents and buckets of ranks or counts.

A chunk is a bounded piece of the text table. It sends records, each once, to the buckets that their key falls in; a
bucket merges what all chunks sent and sends answers back. Records travel as bytes, one row for each chunk and bucket.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import partitions, shared_dir

#: Text in a bucket of the text table, about, and the size of a table from which buckets and chunks grow with its root,
#: so that the pieces that chunks and buckets exchange neither grow in number with the table's square nor shrink.
BUCKET, GROWS = 16 << 20, 64 << 30
DEALT, BACK, REPLY = "bucket int, chunk int, records binary", "chunk int, records binary", "chunk int, bucket int, values binary"


def in_chunks(own: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """own (doc_id, text binary, ...) with `chunk`, about that many bytes each (more in a very large table), and the number of buckets for it. Rows are dealt by id and text, so neither rows without an id nor copies share a chunk."""
    spark = own.sparkSession
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    larger = min(16.0, max(1.0, (total / GROWS) ** 0.5))
    n = max(partitions(spark), int(total / (BUCKET * larger)))
    return own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, int(total / (chunk * larger))))).cast("int")), n


def chunk_table(own: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """in_chunks() as a table bucketed by chunk: grouping by chunk doesn't shuffle it again. And its number of buckets."""
    dealt, n = in_chunks(own, chunk)
    return bucketed(dealt, n), n


def bucketed(df: DataFrame, buckets: int, by: str = "chunk", dealt: bool = False) -> DataFrame:
    """df written as a table bucketed by a column, which later groupings and joins by it don't shuffle. The catalogue doesn't keep its name; its files stay. dealt: df comes from groups by that column over repartition(buckets, by), so each task has a bucket already."""
    spark, name = df.sparkSession, f"strataform_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(buckets, by)).write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def planes(x: np.ndarray) -> bytes:
    """Numbers or records as bytes, first bytes first: the high bytes of small numbers lie together, so they compress to little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def from_planes(data, kind) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes: two each, and place and value of those that are too large for it."""
    low = np.minimum(x, 65535).astype("<u2")
    at = np.flatnonzero(low == 65535)
    return b"".join((np.array([len(x)], "<i8").tobytes(), low.tobytes(), at.astype("<i8").tobytes(), x[at].astype("<i8").tobytes()))


def from_small(data) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    out = np.frombuffer(data, "<u2", n, 8).astype(np.int64)
    at, values = np.frombuffer(data, "<i8", offset=8 + 2 * n).reshape(2, -1)
    out[at] = values
    return out


class Split:
    """How distinct names in order are dealt to buckets: a chunk asks about each once, and gets answers in that order."""

    def __init__(self, names: np.ndarray, buckets: int):
        bucket = (names % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # short ones are sorted by their digits
        self.order = np.argsort(bucket, kind="stable")
        ordered = bucket[self.order].astype(np.int32)
        self.starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.buckets = ordered[self.starts]

    def rows(self, chunk: int, names: np.ndarray, **numbers: np.ndarray) -> pa.Table:
        """Rows (bucket, chunk, names and numbers as bytes), which are given in the names' order."""
        ends = [*self.starts[1:], len(self.order)]
        dealt = {k: [pack(x[a:b]) for a, b in zip(self.starts, ends)] for k, x, pack in (("names", names[self.order], np.ndarray.tobytes), *((k, v[self.order], small) for k, v in numbers.items()))}
        return pa.table({"bucket": pa.array(self.buckets, pa.int32()), "chunk": pa.array([chunk] * len(self.buckets), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in dealt.items()})

    def answers(self, found: pa.Table) -> np.ndarray:
        """The answers of all buckets (rows of REPLY, one small number a name), in the names' order."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = small_columns(found, 1)[0][0]
        return out


def small_columns(found: pa.Table, columns: int) -> tuple[np.ndarray, list[int]]:
    """The small numbers of all buckets (rows of REPLY), so many of each name, bucket after bucket: an array a column. And the names of each bucket."""
    parts = [from_small(x.as_buffer()).reshape(columns, -1) for x in found.sort_by("bucket").column("values")]
    return (np.concatenate(parts, axis=1) if parts else np.empty((columns, 0), np.int64)), [x.shape[1] for x in parts]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in keys that are in order."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def deal(keys: np.ndarray, records: np.ndarray, buckets: int, chunk: int) -> pa.Table:
    """Rows (bucket, chunk, records): the records of each bucket that has any, by key."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    records, edges = records[order], np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = [*edges[1:], len(order)]
    return pa.table({"bucket": pa.array(bucket[order][edges], pa.int32()), "chunk": pa.array([chunk] * len(edges), pa.int32()), "records": pa.array([records[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())})


def back(chunks: np.ndarray, records: np.ndarray) -> pa.Table:
    """Rows (chunk, records): each chunk's answers."""
    order = np.argsort(chunks, kind="stable")
    chunks, records = chunks[order], records[order]
    edges = np.flatnonzero(np.diff(chunks, prepend=-2))
    return pa.table({"chunk": pa.array(chunks[edges], pa.int32()), "records": pa.array([records[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(chunks)])], pa.binary())})


def read(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """The records of all rows, and the chunk that each came from."""
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column("records")]
    return (np.concatenate(parts) if parts else np.empty(0, kind)), np.repeat(table.column("chunk").to_numpy(), [len(x) for x in parts])


def met_twice(table):
    """Of a bucket's short names those that were sent twice or more, back to the chunks that sent them."""
    got, chunks = read(table, np.dtype(("u1", 5)))
    names = wide(got) | np.uint64(table.column("bucket")[0].as_py())
    order = np.argsort(names, kind="stable")
    names, chunks = names[order], chunks[order]
    group = np.cumsum(runs(names)) - 1
    keep = (np.bincount(group) > 1)[group] & runs(names, chunks)
    return back(chunks[keep], names[keep].astype("<u8"))


def short(x: np.ndarray) -> np.ndarray:
    """The upper 40 bits of names as five bytes each; the bucket stands for the rest."""
    return np.ascontiguousarray((x >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def wide(x: np.ndarray) -> np.ndarray:
    """The names whose upper 40 bits short() gave."""
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :5] = x.reshape(-1, 5)
    return out.view("<u8").ravel() << np.uint64(24)


def marked(x: np.ndarray, buckets: int) -> np.ndarray:
    """Names as both sides can tell them: upper 40 bits and bucket."""
    return (x >> np.uint64(24) << np.uint64(24)) | (x % np.uint64(buckets))
