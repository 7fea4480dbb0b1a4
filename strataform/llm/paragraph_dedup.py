"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, and one paragraph of each component kept.

A paragraph is a line; lines of under five words (headings, list items) belong to the paragraph after them, the last
ones of a text to the one before, so all words are in paragraphs that have a whole shingle, but for texts of under five
words. What other texts share of the inside of a paragraph is found as passages: of the text that is left, the
shortest runs of whole sentences with 16 words or more are compared, those that begin and those that end with each
sentence, and what they cover of another, earlier text is cut out.

The band keys of all paragraphs are looked up first, through the packed exchange: only paragraphs that share a key
with another go on to be signed, joined and verified.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._exchange import BACK, DEALT, chunk_table, deal, marked, met_twice, short
from strataform.llm._shared import looked_up, mix, slices
from strataform.llm.near import THRESHOLD, WORDS, band_plan, near_classes, set_name, shingles, signatures
from strataform.tables import cut

#: Short bands, as paragraphs that aren't near copies share almost no shingle, so high recall costs few false meetings.
ROWS, RECALL = 2, 0.999
#: Text in a chunk, about.
CHUNK = 4 << 20
#: Paragraphs in a block: their sets are small, so smaller blocks than those of documents cost little to send.
BLOCK = 256
#: Words from which a run of sentences that occurs before is cut out of any paragraph.
MIN_PASSAGE = 16
_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+|\n|\Z)[ \t\r]*").findall


def whole_under(threshold: float) -> int:
    """Below so many shingles a set is similar enough to none but its equal: n of n + 1 is the most that two sets have in common."""
    return math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1


def paragraphs(text: bytes) -> list[bytes]:
    """The text cut into paragraphs; joined they are the text."""
    out, held, n = [], [], 0
    for line in text.split(b"\n"):
        held.append(line)
        n += len(line.split(None, WORDS))
        if n >= WORDS:
            out.append(b"\n".join(held) + b"\n")
            held, n = [], 0
    rest = b"\n".join(held)
    if not held:  # split() gives one line more than there are ends of lines
        out[-1] = out[-1][:-1]
    elif out:
        out[-1] += rest
    elif rest:
        out.append(rest)
    return out


def _sentences(text: bytes) -> list[list[bytes]]:
    """The sentences of each paragraph."""
    return [[s for s in _SENTENCE(p) if s] for p in paragraphs(text)]


def passages(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first, end, name) of the shortest runs of MIN_PASSAGE words or more that begin or end with each sentence, within a paragraph, sentences numbered through the text. None begins or ends with a blank one.

    They cover each run of sentences with so many words, whatever is around it: what the one that begins it leaves
    out has the words before it to end with.
    """
    own = _sentences(text)
    flat = [s for run in own for s in run]
    each = [s.split() for s in flat]
    sums = [0, *accumulate(map(len, each))]
    spans, low = set(), 0
    for high in accumulate(map(len, own)):  # a paragraph
        end = low
        for first in range(low, high):
            while end < high and sums[end] - sums[first] < MIN_PASSAGE:
                end += 1
            if sums[end] - sums[first] < MIN_PASSAGE:
                break
            if each[first]:
                spans.add((first, end))
        first = low
        for end in range(low + 1, high + 1):
            while sums[end] - sums[first + 1] >= MIN_PASSAGE:
                first += 1
            if each[end - 1] and sums[end] - sums[first] >= MIN_PASSAGE:
                spans.add((first, end))
        low = high
    joined = [b" ".join(x) for x in each]
    return [(a, b, hashlib.blake2b(b" ".join(filter(None, joined[a:b])), digest_size=16).digest()) for a, b in sorted(spans)]


def _eights(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), dtype="<u8")[::2]


def paragraph_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, cleared). copies: (doc_id, paragraph, keep_doc, keep_paragraph) of every paragraph to remove, a near
    copy of another; cleared: (doc_id, n_paragraphs, n_removed, removed, passages, kept) of every row: the numbers of the
    paragraphs removed, (at, size) in bytes of the passages cut out of others, how many both are, and the bytes left.

    Paragraphs are numbered from 0. Of a component the paragraph with the smallest (doc_id, number) stays, and with it
    whatever its own document has of the component; all others go. Then runs of sentences that are word by word the
    same as one that is left in a document with a smaller doc_id are passages to cut out: a sentence goes if such a
    run still has it. A row whose doc_id is null is neither compared nor cut. Rows that repeat a doc_id are one
    document to this operator, told apart by their text. Null and empty texts have no paragraphs; no rows give none.
    Other columns are ignored.
    """
    bands, few = band_plan(threshold, recall, ROWS), whole_under(threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text")).withColumn("row", F.xxhash64("text"))
    texts, n_buckets = chunk_table(own.filter(F.col("doc_id").isNotNull()), CHUNK)
    by_chunk = texts.groupBy("chunk")

    def signed(table):
        """Slices of a chunk's paragraphs: row, number, and signatures. Sets of under `few` shingles are similar enough only if they are equal."""
        row, number, lines = [], [], []
        for r, text in enumerate(table.column("text").to_pylist()):
            for k, line in enumerate(paragraphs(text)):
                if not line.isspace():
                    row.append(r), number.append(k), lines.append(line)
        for at, to in slices(np.array([len(x) for x in lines])):
            yield np.array(row[at:to]), np.array(number[at:to]), *signatures(lines[at:to], bands, ROWS, few)

    def key_names(keys: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """A name for every band key, by band, and the paragraph it belongs to."""
        lengths = np.diff(keys.offsets.to_numpy())
        which = np.repeat(np.arange(len(lengths)), lengths)
        band = np.arange(len(which)) - np.repeat(keys.offsets.to_numpy()[:-1], lengths)
        return mix(keys.values.to_numpy().astype(np.uint64) + mix(band.astype(np.uint64) + np.uint64(1))), which

    def send(key, table):
        names = [np.empty(0, np.uint64), *(key_names(keys)[0] for *_, keys in signed(table)), *(_eights([x[2] for x in passages(t)]) for t in table.column("text").to_pylist())]
        names, n = np.unique(np.concatenate(names), return_counts=True)
        names = np.repeat(names, np.minimum(n, 2))  # two copies say that the chunk alone has it twice
        return deal(names, short(names), n_buckets, key[0].as_py())

    columns = ["chunk", "doc_id", "row", "paragraph", "key", "n", "bands"]

    def survivors(key, table, found):
        known = np.sort(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(x.as_buffer(), "<u8") for x in found.column("records"))]))
        parts = []
        for row, number, sizes, sets, keys in signed(table) if len(known) else ():
            names, which = key_names(keys)
            mark = marked(names, n_buckets)
            hit = known[np.minimum(np.searchsorted(known, mark), len(known) - 1)] == mark
            on = pa.array(np.flatnonzero(np.bincount(which[hit], minlength=len(sizes))))
            ids, rows = (table.column(x).take(pa.array(row)).combine_chunks().take(on) for x in ("doc_id", "row"))
            parts.append(pa.table([pa.array(np.full(len(on), key[0].as_py(), dtype=np.int32)), ids, rows, pa.array(number.astype(np.int32)).take(on), sets.take(on), pa.array(sizes).take(on), keys.take(on)], names=columns))
        none = pa.table([pa.array([], t) for t in (pa.int32(), table.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()))], names=columns)
        return pa.concat_tables([none, *parts])

    shared = cut(by_chunk.applyInArrow(send, DEALT).groupBy("bucket").applyInArrow(met_twice, BACK))
    sigs = cut(by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(survivors, f"chunk int, doc_id {kind}, row bigint, paragraph int, key binary, n int, bands array<bigint>"))
    firsts = sigs.groupBy("key").agg(F.min(F.struct("doc_id", "paragraph", "chunk", "row")).alias("first"))

    def fetch(blocks: DataFrame) -> DataFrame:
        rest = [x for x in blocks.columns if x != "key"]
        wanted = blocks.join(firsts, "key").select(F.col("first.chunk").alias("chunk"), F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), F.col("first.paragraph").alias("paragraph"), "key", *rest)
        types = blocks.select("key", *rest).schema.add("shingles", "binary")

        def sets(key, table, asked):
            texts_of = dict(zip(zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist()), table.column("text").to_pylist()))
            last, own_, got = None, [], []
            for i, r, k in zip(*(asked.column(x).to_pylist() for x in ("doc_id", "row", "paragraph"))):
                if last != (i, r):
                    last, own_ = (i, r), paragraphs(texts_of[i, r])
                got.append(np.unique(shingles([own_[k]])[0]).tobytes())
            return asked.select(["key", *rest]).append_column("shingles", pa.array(got, pa.binary()))

        return by_chunk.cogroup(wanted.sortWithinPartitions("chunk", "doc_id", "row").groupBy("chunk")).applyInArrow(sets, types)

    near = near_classes(sigs.select("key", "n", "bands"), fetch, threshold, BLOCK)
    classes = firsts.join(near, "key", "left").select("key", F.struct("first.doc_id", "first.paragraph").alias("first"), F.coalesce("component", "key").alias("component"))
    keep = classes.groupBy("component").agg(F.min("first").alias("keep"))
    kept = cut(classes.join(keep, "component").select("key", "keep"))
    placed = looked_up(sigs.select("chunk", "doc_id", "row", "paragraph", "key"), kept, "key")  # a class may be a line of every other document
    gone = cut(placed.filter(F.col("doc_id") != F.col("keep.doc_id")).select("chunk", "doc_id", "row", "paragraph", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.paragraph").alias("keep_paragraph")))

    def removed(found) -> dict:
        """The numbers of each row's removed paragraphs."""
        off: dict = {}
        for i, r, k in zip(*(found.column(x).to_pylist() for x in ("doc_id", "row", "paragraph"))):
            if k is not None:
                off.setdefault((i, r), set()).add(k)
        return off

    def rows_of(table):
        return zip(zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist()), table.column("text").to_pylist())

    def met_passages(key, table, found):
        """The runs of sentences that occur twice, outside of removed paragraphs: a row for each, with the places in the chunk that have it."""
        off = removed(found)
        known = np.sort(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(x.as_buffer(), "<u8") for x in found.column("records") if x.is_valid)]))
        met: dict = {}
        for r, (i, text) in enumerate(rows_of(table)) if len(known) else ():
            got = passages(text)
            if not got:
                continue
            mark = marked(_eights([x[2] for x in got]), n_buckets)
            on = np.flatnonzero(known[np.minimum(np.searchsorted(known, mark), len(known) - 1)] == mark)
            gone_ = off.get(i, ()) if len(on) else ()
            of = [k for k, run in enumerate(_sentences(text)) for _ in run] if gone_ else ()
            for first, end, x in (got[k] for k in on):
                if not gone_ or of[first] not in gone_:  # a run lies within one paragraph
                    met.setdefault(x, []).append((r, first, end))
        ids = table.column("doc_id").to_pylist()
        kind_ = table.schema.field("doc_id").type
        at = [[ids[r] for r, *_ in x] for x in met.values()]
        rows_ = table.column("row").to_pylist()
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(met), pa.int32()), "name": pa.array(met.keys(), pa.binary()), "low": pa.array(map(min, at), kind_), "high": pa.array(map(max, at), kind_), "docs": pa.array(at, pa.list_(kind_)),
            "rows": pa.array([[rows_[r] for r, *_ in x] for x in met.values()], pa.list_(pa.int64())), "firsts": pa.array([[f for _, f, _ in x] for x in met.values()], pa.list_(pa.int32())), "ends": pa.array([[e for *_, e in x] for x in met.values()], pa.list_(pa.int32())),
        })

    places = gone.select("chunk", "doc_id", "row", "paragraph")
    lists = f"docs array<{kind}>, rows array<bigint>, firsts array<int>, ends array<int>"
    runs = cut(by_chunk.cogroup(places.unionByName(shared, allowMissingColumns=True).groupBy("chunk")).applyInArrow(met_passages, f"chunk int, name binary, low {kind}, high {kind}, {lists}"))
    before = cut(runs.groupBy("name").agg(F.min("low").alias("before"), F.max("high").alias("last"), F.count(F.lit(1)).alias("n")).filter("before < last").drop("last"))
    # Runs that more than one in a thousand of all rows hold, a thousand at most, are broadcast: none fills a task.
    many = F.col("n") > runs.count() / 1000
    often = F.broadcast(before.filter(many))
    later = lambda rows: rows.filter("high != before").select("chunk", "before", "docs", "rows", "firsts", "ends")
    rare = runs.join(often.select("name"), "name", "left_anti").join(before.filter(~many), "name")
    again = cut(later(runs.join(often, "name")).unionByName(later(rare)))

    def clear(key, table, found):
        off, sentences = removed(found), {}
        for one, *lists_ in zip(*(found.column(c).to_pylist() for c in ("before", "docs", "rows", "firsts", "ends"))):
            for i, r, first, end in zip(*lists_) if one is not None else ():
                if i != one:
                    sentences.setdefault((i, r), set()).update(range(first, end))
        n, gone_, cuts, left = [], [], [], []
        for i, text in rows_of(table):
            own_ = _sentences(text)
            mine = sorted(off.get(i, ()))
            n.append(len(own_)), gone_.append(mine)
            if not mine and i not in sentences:
                cuts.append([]), left.append(text)
                continue
            of, flat = [k for k, run in enumerate(own_) for _ in run], [s for run in own_ for s in run]
            again_ = sentences.get(i, ())
            drop_ = [k in again_ for k in range(len(flat))]
            whole, spans, at, open_ = set(mine), [], 0, False
            for s, k, x in zip(flat, of, drop_):
                x = x and k not in whole
                if x and open_:
                    spans[-1]["size"] += len(s)
                elif x:
                    spans.append({"at": at, "size": len(s)})
                at, open_ = at + len(s), x
            cuts.append(spans), left.append(b"".join(s for s, k, x in zip(flat, of, drop_) if k not in whole and not x))
        count = [len(a) + len(b) for a, b in zip(gone_, cuts)]
        return pa.table({"doc_id": table.column("doc_id"), "n_paragraphs": pa.array(n, pa.int64()), "n_removed": pa.array(count, pa.int64()), "removed": pa.array(gone_, pa.list_(pa.int32())), "passages": pa.array(cuts, pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())]))), "kept": pa.array(left, pa.binary())})

    found = places.unionByName(again, allowMissingColumns=True)
    spans = "array<struct<at: int, size: int>>"
    cleared = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(clear, f"doc_id {kind}, n_paragraphs bigint, n_removed bigint, removed array<int>, passages {spans}, kept binary")
    aside = own.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_paragraphs"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("removed"), F.array().cast(spans).alias("passages"), F.col("text").alias("kept"))
    return gone.drop("chunk", "row"), cleared.unionByName(aside)


def digests(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, removed, passages and kept_sha256 of every row."""
    return paragraph_copies(docs, **columns)[1].select("doc_id", "n_paragraphs", "n_removed", "removed", "passages", F.sha2("kept", 256).alias("kept_sha256"))
