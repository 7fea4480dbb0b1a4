"""Removal of repeated byte strings by distributed prefix doubling.

Positions are ranked by longer and longer prefixes of their suffixes: 25 bytes, then 50, the threshold. A rank is the
prefix's fingerprint, and the rank at 50 is made from the pair of ranks (25 at i, 25 at i + 25), as doubling does;
Spark deals (rank, position) pairs out by rank, each task sorts its own, and positions whose rank no other document
has are dropped before the next offset.

The last round's ranks are 128 bits wide, and those of the second are compared within one first rank only, so texts
that aren't equal don't meet by chance. Three things keep it within the disk that a cluster has. Only content-chosen positions take part in the first round:
of the 26 starts of 25-byte strings in each 50-byte window, the one with the least fingerprint. Equal windows choose
alike, so no match is lost, while about one position in thirteen is left. Second, neighbouring windows that chose the
same position are ranked as one block (up to 75 bytes) in the second round. Only where one chosen position has
several different blocks, as at the borders of a match, does the third round rank the single windows. And a chunk of
documents sends each rank once, with the smallest document that has it, so a passage that a third of all documents
hold is sent once a chunk and no task receives its occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm._exchange import BACK, DEALT, back, chunk_table, deal, marked, met_twice, read, runs, short
from strataform.llm._shared import cut, mix, order_numbers, quoted, slices

LENGTH = 50
#: Text in a chunk, about.
CHUNK = 4 << 20
_MASK = np.uint64((1 << 20) - 1)
_BASE = 0xD6E8FEB86659FD93


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = _table()
_OTHER, _OTHER_BYTE = 0xA24BAED4963EE407, mix(_BYTE ^ np.uint64(0x9FB21C651E98DF25))


def _join(a: np.ndarray, b: np.ndarray, skip: int, base: int = _BASE) -> np.ndarray:
    """Fingerprints of strings from those of their parts: the second part, of `skip` bytes, begins where the first ends."""
    return a * np.uint64(pow(base, skip, 1 << 64)) + b


def prefixes(data: np.ndarray, length: int, base: int = _BASE, of_byte: np.ndarray = _BYTE) -> np.ndarray:
    """Fingerprints of the strings of `length` bytes from each position, by doubling."""
    have, size = of_byte[data], 1
    one = have
    for bit in bin(length)[3:]:
        have = _join(have[: len(have) - size], have[size:], size, base) if len(have) > size else have[:0]
        size *= 2
        if bit == "1":
            have = _join(have[:-1], one[size : size + len(have) - 1], 1, base) if len(have) else have
            size += 1
    return have


def _least(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


_NAME = np.dtype([("a", "<u8"), ("b", "<u8")])


class Blocks:
    """The blocks of some documents: runs of windows that chose the same position."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        half, self.length = length // 2, length
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if len(data) < length:
            self.doc = self.first = self.last = np.empty(0, np.int64)
            self.anchor = self.name = np.empty(0, np.uint64)
            return
        self._data, self._half = data, prefixes(data, half)
        choice = (self._half & ~_MASK) | (np.arange(len(self._half), dtype=np.uint64) & _MASK)
        least = _least(choice, length - half + 1)
        at = np.arange(len(least))
        chosen = at + ((least.astype(np.int64) - at) & int(_MASK))
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        fits = at + length <= self.begin[1:][doc]
        new = np.empty(len(at), dtype=bool)
        new[0], new[1:] = True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new & fits)
        ends = np.flatnonzero(fits & np.concatenate((new[1:] | ~fits[1:], [True])))
        self.doc, self.first, self.last = doc[starts], starts, ends
        self.anchor = mix(self._half[chosen[starts]])
        self.name = mix(self._whole(starts)) * np.uint64(3) + mix(self._whole(ends) + (ends - starts).astype(np.uint64))

    def _whole(self, at: np.ndarray) -> np.ndarray:
        half = self.length // 2
        whole = _join(self._half[at], self._half[at + half], half)
        return _join(whole, self._half[at + self.length - half], 1) if self.length % 2 else whole

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names, of 128 bits, of the windows of the blocks `which`."""
        n = self.last[which] - self.first[which] + 1
        at = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        names = np.empty(len(at), _NAME)
        names["a"], names["b"] = mix(self._whole(at)), mix(prefixes(self._data, self.length, _OTHER, _OTHER_BYTE)[at])
        return at, names


_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
_WINDOW = _RECORD
_FOUND = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("many", "?")])


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row.

    A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id, as the
    input stands. Texts are taken as UTF-8, null as empty; texts under `length` bytes lose nothing. A row whose doc_id
    is null is neither cut nor compared; rows with the same doc_id aren't smaller than each other. doc_id may be of any type that sorts; ids that aren't whole
    numbers are numbered in order first. No rows give none. whole_characters:
    bytes left of a character that was cut go as well (from kept alone). carry: columns of docs that are returned as
    they are, in a struct `rest`; others are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = None if isinstance(docs.schema[id_col].dataType, T.IntegralType) else cut(order_numbers(docs.select(F.col(id_col).alias("doc_id"))))
    own = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"), *([F.struct(*(F.col(quoted(x)).alias(f"c{k}") for k, x in enumerate(carry))).alias("rest")] if carry else []))
    some = own.filter(F.col("doc_id").isNotNull())
    some = some.withColumn("place", F.col("doc_id").cast("long")) if numbers is None else some.join(numbers, "doc_id")
    texts, n_buckets = chunk_table(some, CHUNK)

    def parts(table: pa.Table):
        """Slices of a chunk: (first row, doc_ids, blocks)."""
        ids, data = table.column("place").to_numpy(), table.column("text").to_pylist()
        for at, to in slices(np.array([len(x) for x in data]), 1 << 18):
            yield at, ids[at:to], data[at:to], Blocks(data[at:to], length)

    def first_ranks(key, table):
        names, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, ids, _, blocks in parts(table):
            names.append(blocks.anchor), owner.append(ids[blocks.doc])
        names, owner = np.concatenate(names), np.concatenate(owner)
        order = np.lexsort((owner, names))
        names, owner = names[order], owner[order]
        new = runs(names)
        many = np.zeros(len(names), dtype=bool)
        many[1:] = ~new[1:] & (owner[1:] != owner[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group[many], minlength=group[-1] + 1 if len(group) else 0) > 0
        names = names[new]
        # one copy if one document of the chunk has the rank, two if several have
        return deal(np.repeat(names, 1 + several), short(np.repeat(names, 1 + several)), n_buckets, key[0].as_py())

    def second_ranks(key, table, found):
        known = np.sort(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(x.as_buffer(), "<u8") for x in found.column("records"))]))
        out = [np.empty(0, _RECORD)]
        for _, ids, _, blocks in parts(table) if len(known) else ():
            mark = marked(blocks.anchor, n_buckets)
            at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
            on = np.flatnonzero(known[at] == mark)
            got = np.empty(len(on), _RECORD)
            got["a"], got["b"], got["doc"] = blocks.anchor[on], blocks.name[on], ids[blocks.doc[on]]
            out.append(got)
        got = np.concatenate(out)
        got = got[np.lexsort((got["doc"], got["b"], got["a"]))]
        got = got[runs(got["a"], got["b"])]
        return deal(got["a"], got, n_buckets, key[0].as_py())

    def first_block(table):
        got, chunks = read(table, _RECORD)
        order = np.lexsort((got["doc"], got["b"], got["a"]))
        got, chunks = got[order], chunks[order]
        new, anchor = runs(got["a"], got["b"]), runs(got["a"])
        per_anchor = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor)) if len(got) else np.empty(0, np.int64)
        out = np.empty(len(got), _FOUND)
        out["a"], out["b"], out["doc"] = got["a"], got["b"], got["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
        out["many"] = (per_anchor > 1)[np.cumsum(anchor) - 1]
        return back(chunks, out)

    def settle(found: pa.Table):
        known = np.concatenate([np.empty(0, _FOUND), *(np.frombuffer(x.as_buffer(), _FOUND) for x in found.column("records"))])
        mark = known["a"] * np.uint64(5) + known["b"]
        order = np.argsort(mark, kind="stable")
        return mark[order], known[order]

    def look_up(known, marks: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """The blocks that have a record, and those records."""
        mark = blocks.anchor * np.uint64(5) + blocks.name
        at = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
        on = np.flatnonzero((marks[at] == mark) & (known["a"][at] == blocks.anchor) & (known["b"][at] == blocks.name))
        return on, known[at[on]]

    def third_ranks(key, table, found):
        marks, known = settle(found)
        out = [np.empty(0, _WINDOW)]
        for _, ids, _, blocks in parts(table) if known["many"].any() else ():
            on, got = look_up(known, marks, blocks)
            here = on[got["many"] & (got["doc"] == ids[blocks.doc[on]])]
            if len(here):
                at, names = blocks.windows(here)
                rows = np.empty(len(at), _WINDOW)
                rows["a"], rows["b"], rows["doc"] = names["a"], names["b"], np.repeat(ids[blocks.doc[here]], blocks.last[here] - blocks.first[here] + 1)
                out.append(rows)
        got = np.concatenate(out)
        got = got[np.lexsort((got["doc"], got["b"], got["a"]))]
        got = got[runs(got["a"], got["b"], got["doc"])]
        new = runs(got["a"], got["b"])
        new[1:] |= new[:-1]  # the two smallest documents: one alone is no match
        got = got[new]
        return deal(got["a"], got, n_buckets, key[0].as_py())

    def first_window(table):
        got, chunks = read(table, _WINDOW)
        order = np.lexsort((got["doc"], got["b"], got["a"]))
        got, chunks = got[order], chunks[order]
        new = runs(got["a"], got["b"])
        group = np.cumsum(new) - 1
        first = got["doc"][np.flatnonzero(new)][group]
        keep = (np.bincount(group) > 1)[group]
        out = got[keep].copy()
        out["doc"] = first[keep]
        return back(chunks[keep], out)

    def remove(key, table, found):
        single = np.array(found.column("single").to_pylist(), dtype=bool)
        marks, known = settle(found.filter(pa.array(~single)))
        windows = np.concatenate([np.empty(0, _WINDOW), *(np.frombuffer(x.as_buffer(), _WINDOW) for x in found.filter(pa.array(single)).column("records"))])
        w_marks = windows["a"] * np.uint64(5) + windows["b"]
        windows, w_marks = windows[order := np.argsort(w_marks, kind="stable")], w_marks[order]
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for _, ids, data, blocks in parts(table):
            cover = np.zeros(blocks.begin[-1] + 1, dtype=np.int32)
            if len(known):
                on, got = look_up(known, marks, blocks)
                mine = ids[blocks.doc[on]]
                gone = on[got["doc"] < mine]
                np.add.at(cover, blocks.first[gone], 1), np.add.at(cover, blocks.last[gone] + length, -1)
                unsure = on[got["many"] & (got["doc"] == mine)]
                if len(unsure) and len(windows):
                    at, names = blocks.windows(unsure)
                    owner = np.repeat(ids[blocks.doc[unsure]], blocks.last[unsure] - blocks.first[unsure] + 1)
                    k = np.minimum(np.searchsorted(w_marks, names["a"] * np.uint64(5) + names["b"]), len(windows) - 1)
                    at = at[(windows["a"][k] == names["a"]) & (windows["b"][k] == names["b"]) & (windows["doc"][k] < owner)]
                    np.add.at(cover, at, 1), np.add.at(cover, at + length, -1)
            cover = np.cumsum(cover)[:-1] > 0
            flat = np.frombuffer(b"".join(data), dtype=np.uint8)
            for text, a, b in zip(data, blocks.begin[:-1], blocks.begin[1:]):
                off = cover[a:b]
                n_bytes.append(b - a), n_removed.append(int(off.sum()))
                n_spans.append(int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()))
                rest = flat[a:b][~off].tobytes() if n_removed[-1] else text
                kept.append(rest.decode("utf-8", "ignore").encode() if whole_characters and n_removed[-1] else rest)
        return pa.table({x: table.column(x) for x in front} | {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    by_chunk = texts.groupBy("chunk")
    shared = cut(by_chunk.applyInArrow(first_ranks, DEALT).groupBy("bucket").applyInArrow(met_twice, BACK))
    blocks = cut(by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(second_ranks, DEALT).groupBy("bucket").applyInArrow(first_block, BACK))
    windows = cut(by_chunk.cogroup(blocks.groupBy("chunk")).applyInArrow(third_ranks, DEALT).groupBy("bucket").applyInArrow(first_window, BACK))
    found = blocks.withColumn("single", F.lit(False)).unionByName(windows.withColumn("single", F.lit(True)))
    front = {"doc_id": kind} | ({"rest": own.schema["rest"].dataType.simpleString()} if carry else {})
    cleared = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(remove, f"{', '.join(f'{k} {v}' for k, v in front.items())}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    aside = own.filter(F.col("doc_id").isNull()).select(*front, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))
    both = cleared.unionByName(aside)
    return both.withColumn("rest", F.struct(*(F.col(f"rest.c{k}").alias(x) for k, x in enumerate(carry)))) if carry else both
