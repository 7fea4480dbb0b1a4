"""Packing token pieces into sequences: linear grouping, few-size configurations, actual pieces, then best fit.

The plan is made from counts of lengths, of which there are at most as many as a sequence has tokens, so it has a
bounded size whatever the table holds; Spark numbers the pieces of each length and gives each its place.
"""

from __future__ import annotations

import bisect
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.llm._shared import cut, partitions, text_slices

LENGTH = 1024
#: Size groups for the large pieces, and the longest piece that counts as small. With this many groups a common length
#: is a group of its own, and only rare lengths are rounded up.
GROUPS, SMALL = 1024, 48


@cache
def _tokenizer(path: str):
    """Of a text its ids as the vocabulary file's own library gives them.

    The file's ranks run in tiktoken, several times as fast with the same ids; texts that hold a special token's
    string, or files of another make, go through tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = cache(lambda: Tokenizer.from_file(path))  # most workers never need it
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    pre = made.get("pre_tokenizer") or {}
    model = made["model"]
    plain = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("ignore_merges")
    if not plain:
        return lambda text: slow().encode(text, add_special_tokens=False).ids
    # A byte stands as itself if it prints, else as the next code point from 256 on: the format of byte-level files.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(x in text for x in special):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces: ids and then end_id, cut from the end so that only the first piece may be short."""

    def run(batches):
        encode = _tokenizer(path)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for r, text in enumerate(x for *_, texts in text_slices(batch, "text") for x in texts):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                edges = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(r), piece.append(k), start.append(a), size.append(b - a), crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def group_lengths(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Linear grouping: each length's rounded size, the largest of its group; groups hold about as many pieces each."""
    total, held, size, out = sum(counts.values()), 0, 0, {}
    share = max(1, -(-total // max(1, groups)))
    for n in sorted(counts, reverse=True):
        if held == 0:
            size = n
        out[n] = size
        held += counts[n]
        if held >= share:
            held = 0
    return out


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes of one sequence, number of such sequences) that use up counts.

    Each configuration takes the largest size left and the fullest choice of others beside it (a subset sum with
    larger sizes first), as often as the counts allow; so each uses up a size, and there are few of them.
    """
    left, out = dict(counts), []
    while left:
        first = max(left)
        room = capacity - first
        sizes = sorted((s for s in left if s <= room), reverse=True)
        took = np.zeros(room + 1, dtype=np.int64)  # the size that first reached a sum
        reached = np.zeros(room + 1, dtype=bool)
        reached[0] = True
        for s in sizes:
            for _ in range(min(left[s] - (s == first), room // s)):
                new = np.zeros_like(reached)
                new[s:] = reached[:-s] & ~reached[s:]
                if not new.any():
                    break
                took[new], reached = s, reached | new
            if reached[room]:
                break
        at, config = int(np.flatnonzero(reached)[-1]), [first]
        while at:
            config.append(int(took[at]))
            at -= config[-1]
        need = {s: config.count(s) for s in config}
        times = min(left[s] // k for s, k in need.items())
        out.append((config, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def best_fit(bins: dict[int, int], items: dict[int, int]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Small items, longest first, each into the bin with the least room that takes it; works on counts.

    Returns (length, count, the bins' first room, index of the first of those bins) and what found no place.
    """
    open_bins = sorted((room, room, 0, n) for room, n in bins.items() if room > 0)  # room now, room at first, first index, bins
    placed, rest = [], {}
    for length in sorted(items, reverse=True):
        left = items[length]
        while left:
            k = bisect.bisect_left(open_bins, (length,))
            if k == len(open_bins):
                rest[length] = left
                break
            room, origin, at, n = open_bins.pop(k)
            take = min(n, left)
            placed.append((length, take, origin, at))
            left -= take
            if take < n:
                bisect.insort(open_bins, (room, origin, at + take, n - take))
            if room > length:
                bisect.insort(open_bins, (room - length, origin, at, take))
    return placed, rest


def _numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with `at`: each row's number among those of its `by`, from 0. Rows are numbered within shares of a bounded part of a `by`, then shares are added up, so no value of `by` meets in one task if rows differ in the order's columns."""
    df = df.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(partitions(df.sparkSession))))
    before = Window.partitionBy(by).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = df.groupBy(by, "_share").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy(by, "_share").orderBy(*order))
    return df.withColumn("_own", own).join(shares, [by, "_share"]).withColumn("at", F.col("_before") + F.col("_own") - 1).drop("_share", "_own", "_before")


def _place(df: DataFrame, segments: list[tuple], name: str) -> DataFrame:
    """df (with by, at) and the columns (name, slot) that its segment gives: (by, first at, first sequence, rows of it in a sequence, first slot)."""
    plan = sorted(segments)
    keys = np.array([(by << 48) + at for by, at, *_ in plan], dtype=np.int64)
    bases, per, slot0 = (np.array([x[k] for x in plan], dtype=np.int64) for k in (2, 3, 4))
    firsts = np.array([x[1] for x in plan], dtype=np.int64)

    def run(batches):
        for batch in batches:
            by, at = (batch.column(x).to_numpy() for x in ("_by", "at"))
            k = np.searchsorted(keys, (by << 48) + at, "right") - 1
            off = at - firsts[k]
            yield batch.append_column(name, pa.array(bases[k] + off // per[k])).append_column("slot", pa.array(slot0[k] + off % per[k]))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kind}, {name} bigint, slot bigint")


def pack(table: DataFrame, length: int = LENGTH, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """table's columns, sequence_id and offset; table: (doc_id, piece, start, length, ids_crc32), each length from 1 to `length`, one that can be read again. _row, a number that each row has alone, tells equal rows apart if it is there, and is left out.

    Full pieces have a sequence each (negative ids). The others are planned from counts of lengths: at most `length`
    of them reach the driver, and the plan it sends back has a few segments a length.
    """
    columns, order = [x for x in table.columns if x != "_row"], ["doc_id", "piece", "ids_crc32", *(["_row"] if "_row" in table.columns else [])]
    full = table.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = table.filter(F.col("length") < length)
    counts = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}
    large, tiny = {k: v for k, v in counts.items() if k > small}, {k: v for k, v in counts.items() if k <= small}
    if not counts:
        return full.select(*columns, "sequence_id", "offset")
    rounded = group_lengths(large, groups)
    in_group: dict[int, int] = {}
    ahead: dict[int, int] = {}  # pieces of longer lengths in the same group
    for n in sorted(large, reverse=True):
        ahead[n] = in_group.get(rounded[n], 0)
        in_group[rounded[n]] = ahead[n] + large[n]
    used, segments, base, sums = dict.fromkeys(in_group, 0), [], 0, []
    for config, times in configurations(in_group, length):
        slot = 0
        for size in sorted(set(config), reverse=True):
            per = config.count(size)
            segments.append((size, used[size], base, per, slot))
            used[size] += per * times
            slot += per
        base += times
    numbered = cut(_numbered(part.withColumn("_by", F.col("length")), "_by", order))
    sized = {n: (rounded[n], ahead[n]) for n in large}

    def to_groups(batches):
        sizes, firsts = np.zeros(length + 1, dtype=np.int64), np.zeros(length + 1, dtype=np.int64)
        for n, (size, first) in sized.items():
            sizes[n], firsts[n] = size, first
        for batch in batches:
            n = batch.column("length").to_numpy()
            out = batch.set_column(batch.schema.get_field_index("_by"), "_by", pa.array(sizes[n]))
            yield out.set_column(out.schema.get_field_index("at"), "at", pa.array(batch.column("at").to_numpy() + firsts[n]))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    big = numbered.filter(F.col("length") > small).mapInArrow(to_groups, kind)
    placed = cut(_place(big, segments, "sequence_id").drop("_by", "at")) if large else None
    out = []
    if placed is not None:
        out.append(placed)
    if tiny:
        rooms: dict[int, int] = {}
        bins = None
        if placed is not None:
            bins = placed.groupBy("sequence_id").agg((F.lit(length) - F.sum("length")).alias("_by")).filter(F.col("_by") > 0)
            bins = cut(_numbered(bins, "_by", ["sequence_id"]))
            rooms = {r["_by"]: r["count"] for r in bins.groupBy("_by").count().collect()}
        fitted, rest = best_fit(rooms, tiny)
        done = dict.fromkeys(tiny, 0)
        into = []
        for n, count, origin, at in fitted:  # `sequence_id` stands for room and number of the bin until they are joined
            into.append((n, done[n], (origin << 40) + at, 1, 1 << 20))
            done[n] += count
        for config, times in configurations(rest, length):
            slot = 0
            for size in sorted(set(config), reverse=True):
                per = config.count(size)
                into.append((size, done[size], -1 - base - times + 1, per, slot))
                done[size] += per * times
                slot += per
            base += times
        small_rows = _place(numbered.filter(F.col("length") <= small), into, "_bin").drop("_by", "at")
        own = small_rows.filter(F.col("_bin") < 0).withColumn("sequence_id", -1 - F.col("_bin")).drop("_bin")
        out.append(own)
        if bins is not None:
            where = bins.select((F.shiftleft("_by", 40) + F.col("at")).alias("_bin"), "sequence_id")
            out.append(small_rows.filter(F.col("_bin") >= 0).join(where, "_bin").drop("_bin"))
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    before = Window.partitionBy("sequence_id").orderBy(F.col("slot"), F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select(*columns, "sequence_id", "offset").unionByName(full.select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A null text counts as empty: a piece of the end token alone. Rows that repeat a doc_id are packed each; a table
    without rows gives none; other columns are ignored.
    """
    return pack(cut(pieces(docs, path, end_id, length, **columns).withColumn("_row", F.monotonically_increasing_id())), length)
