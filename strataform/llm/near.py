"""Near copies by MinHash banding, verified on full shingle sets, without ever making a row for each pair.

Items with the same shingle set are one class from the start. Classes that share a band bucket are dealt into blocks
of bounded size, similar ones side by side; each pair of blocks that shares a bucket is a cell, and a task compares
the shingle sets of the classes in its cell. So a group of any size is spread over many tasks, and every pair is seen
in just one cell. Numbers of links need all pairs of a group to be looked at: a class of a group of N goes to N / 1024
cells, not to N partners.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import mix, partitions, words
from strataform.operators.graph import components
from strataform.tables import cut, drop

WORDS = 5
THRESHOLD = 0.8
#: Classes in a block, and shingles in their sets: what a task holds of each of the two blocks that it compares. Larger
#: blocks send a large group's sets around less often, smaller ones compare fewer classes that don't share a bucket.
BLOCK, SHINGLES = 1024, 2 << 20


def band_plan(threshold: float, recall: float, rows: int) -> int:
    """Bands of `rows` hashes for which a pair at the threshold meets with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@cache
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-word shingles and each text's first (one more at the end). Fewer words make one shingle; none make none."""
    hashes, first = words(texts)
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    padded = np.concatenate((hashes, np.zeros(n, dtype=np.uint64)))
    at = np.repeat(first[:-1] - starts[:-1], sizes) + np.arange(starts[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        part = padded[at + k]
        if len(at):
            part = np.where(at + k < np.repeat(first[1:], sizes), part, np.uint64(k + 1))
        out = mix(out ^ part) + part
    return out, starts


_OTHER = np.uint64(0xA0761D6478BD642F)


def set_name(distinct: np.ndarray) -> bytes | None:
    """128 bits that name a set of hashes; None for the empty set."""
    return np.array([mix(distinct).sum(), mix(distinct ^ _OTHER).sum()], dtype="<u8").tobytes() if len(distinct) else None


def signatures(texts: list[bytes], bands: int, rows: int, whole_under: int = 0) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text: number of distinct shingles, name of their set (null if empty), band keys.

    A set of under `whole_under` shingles has its own name as its only band key: right where no other set can be
    similar enough.
    """
    seeds = _seeds(bands * rows)
    hashes, starts = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, sizes = hashes[new], np.bincount(owner[new], minlength=len(texts))
    some = np.flatnonzero(sizes)
    at = np.cumsum(sizes[some]) - sizes[some]
    names = np.empty((len(some), 2), dtype="<u8")
    keys = np.zeros((len(some), bands), dtype=np.uint64)
    if len(some):
        names[:, 0], names[:, 1] = np.add.reduceat(mix(hashes), at), np.add.reduceat(mix(hashes ^ _OTHER), at)
        for k in range(bands * rows):
            mixed = (hashes ^ seeds[k]) * seeds[k - 1]
            mixed ^= mixed >> np.uint64(29)
            least = np.minimum.reduceat(mixed * np.uint64(0x9FB21C651E98DF25), at)
            keys[:, k // rows] = mix(keys[:, k // rows] ^ least) + least
    per = np.where(sizes[some] < whole_under, 1, bands)
    keys[per == 1, 0] = names[per == 1, 0] if bands > 1 else keys[per == 1, 0]
    flat = keys[np.arange(bands)[None, :] < per[:, None]].astype(np.int64)
    lengths = np.zeros(len(texts), dtype=np.int64)
    lengths[some] = per
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    place = np.full(len(texts), -1)
    place[some] = np.arange(len(some))
    named = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(some), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
    return sizes.astype(np.int32), named.take(pa.array(place, pa.int64(), mask=place < 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def near_classes(sigs: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, most: int | None = None) -> DataFrame:
    """(key, component, links) of every class that has a link.

    sigs: (key binary: name of the shingle set, n int: its size, bands array<long>), one row an item, already a table
    that can be read again. fetch: from rows with key, and other columns, to the same with the sets: `shingles`,
    little-endian unsigned 64-bit integers in order; may give a key twice. component is the smallest key that links lead to; links
    counts the items, copies included, of the other classes that are at least as similar as the threshold. most:
    classes in a block.
    """
    most = most or BLOCK
    spark = sigs.sparkSession
    classes = cut(sigs.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("size")).withColumn("uid", F.xxhash64("key")))
    # Two keys with one uid are merely compared once more than they need be.
    spread = classes.select("uid", F.posexplode("bands").alias("band", "least")).select("uid", F.xxhash64("band", "least").alias("bucket"))
    buckets = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("uid").alias("first")).filter("members > 1").drop("members"))
    shared = cut(spread.join(buckets, "bucket"))
    drop(buckets)

    def deal(batches):
        block, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks = []
            for size in batch.column("n").to_pylist():
                if rows and (rows >= most or held + size > SHINGLES):
                    block, rows, held = block + 1, 0, 0
                rows, held = rows + 1, held + size
                blocks.append(block)
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    labels = shared.groupBy("uid").agg(F.min("first").alias("label")).join(classes.select("uid", "key", "n", "size"), "uid")
    ordered = labels.repartitionByRange(partitions(spark), "label", "key").sortWithinPartitions("label", "key").drop("label")
    blocks = cut(ordered.mapInArrow(deal, "uid bigint, key binary, n int, size bigint, block bigint"))
    drop(classes)
    # A class goes to the cell of two blocks if a bucket holds it and a class of the other block.
    members = shared.select("uid", "bucket").join(blocks.select("uid", "block"), "uid")
    met = cut(members.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.collect_list(F.struct("block", "n")).alias("met")).filter((F.size("met") > 1) | (F.col("met")[0]["n"] > 1)))
    # Blocks are gathered for each class before they become rows, as a class meets the same ones in many buckets.
    others = members.join(met, "bucket").select("uid", "block", F.transform(F.filter("met", lambda x: (x["block"] != F.col("block")) | (x["n"] > 1)), lambda x: x["block"]).alias("other"))
    gathered = others.groupBy("uid", "block").agg(F.array_distinct(F.flatten(F.collect_list("other"))).alias("other"))
    cells = cut(gathered.select("uid", F.transform("other", lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))).alias("cells")).filter(F.size("cells") > 0))
    drop(shared), drop(met)
    sent = blocks.join(cells, "uid").drop("uid")  # each class once, with its cells: sets are made before they are sent out
    items = fetch(sent).withColumn("cell", F.explode("cells")).select("key", "n", "size", "block", "shingles", "cell.a", "cell.b")

    def compare(table: pa.Table) -> pa.Table:
        frame = table.select(["key", "n", "size", "block", "a", "b", "shingles"]).to_pandas().drop_duplicates("key")
        frame = frame.sort_values(["block", "key"]).reset_index(drop=True)
        links, root = _links(frame, threshold)
        on = np.flatnonzero(links)
        return pa.table({"key": pa.array(frame["key"].iloc[on].tolist(), pa.binary()), "root": pa.array([frame["key"].iloc[root[i]] for i in on], pa.binary()), "links": pa.array(links[on], pa.int64())})

    found = cut(items.groupBy("a", "b").applyInArrow(compare, "key binary, root binary, links long"))
    drop(cells)
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    return counts.join(components(found.filter(F.col("key") != F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()), "key")


def _links(frame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a cell its links and the first class of its component within the cell."""
    n, size, block = frame["n"].to_numpy(), frame["size"].to_numpy(), frame["block"].to_numpy()
    same = frame["a"].iloc[0] == frame["b"].iloc[0] if len(frame) else True
    left = np.arange(len(frame)) if same else np.flatnonzero(block == frame["a"].iloc[0])
    right = left if same else np.flatnonzero(block == frame["b"].iloc[0])
    parts = [np.frombuffer(x, dtype="<u8") for x in frame["shingles"]]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1
    keep = often[column] if len(column) else np.empty(0, bool)
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]] if len(column) else column
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    row_of = np.full(len(frame), -1)
    for base in range(0, int(often.sum()), 2048):
        here = slice(*np.searchsorted(column, [base, base + 2048]))
        dense = np.zeros((len(frame), 2048), dtype=np.float32)
        dense[owner[here], column[here] - base] = 1
        inter += dense[left] @ dense[right].T
    union = n[left][:, None] + n[right][None, :] - inter
    linked = inter >= threshold * union - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(frame), dtype=np.int64)
    links[left] = linked @ size[right]
    if not same:
        links[right] += linked.T @ size[left]
    root = np.arange(len(frame))
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low), np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return links, root
