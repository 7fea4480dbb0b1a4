"""Periodic runs of words, found lag by lag on bit planes of the word numbers."""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm._shared import text_slices

#: Places compared at once while lags are told apart that can hold a run from those that can't.
SAMPLES = 1 << 16


_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def _agree(ids: np.ndarray, lag, at: np.ndarray) -> np.ndarray:
    """At which places some words before the third multiple equal those a lag later."""
    hit = np.ones(len(at), bool)
    for part in (lag // 2, lag + lag // 2, lag // 3, 2 * lag - 1, lag // 5, lag + lag // 4):
        hit &= ids[at + part] == ids[at + part + lag]
    return hit


def _possible(ids: np.ndarray, most: int):
    """(lag, places): in rising order each lag up to `most` with the places k*lag from which four words, a lag apart, are the same.

    A run of four periods or more has lag-apart equal words at three multiples of the lag in a row at least, so no lag
    that holds a run is left out; only multiples are read, n/lag of them, about n*log(n) for all lags together. Between
    the first and the third multiple every word of a run equals the one a lag later: a few are looked at.
    """
    n, lag = len(ids), 1
    while lag <= most and n // lag > SAMPLES // 4:
        same = ids[lag::lag] == ids[: n - lag : lag]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag
        yield lag, at[_agree(ids, lag, at)]
        lag += 1
    while lag <= most:
        to = min(most + 1, lag + max(1, SAMPLES // (n // lag)))
        lags = np.arange(lag, to)
        each = np.maximum((n - 1) // lags - 2, 0)
        q = np.repeat(lags, each)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)) * q
        first = ids[at]
        hit = np.flatnonzero((first == ids[at + q]) & (first == ids[at + 2 * q]) & (first == ids[at + 3 * q]))
        q, at = q[hit], at[hit]
        hit = _agree(ids, q, at)
        q, at = q[hit], at[hit]
        edges = np.flatnonzero(np.diff(q, prepend=0))
        for a, b in zip(edges, [*edges[1:], len(q)]):
            yield int(q[a]), at[a:b]
        lag = to


def _planes(ids: np.ndarray) -> list[int]:
    """One big integer for each bit of the numbers: bit i belongs to word i."""
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def _ones(x: int) -> np.ndarray:
    """Which bits are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start, then period. `times` is four or more.

    At a lag, planes shifted by it are XORed with themselves and ORed, so a bit is set where words a lag apart differ.
    ANDing the rest with itself, shifted by doubling distances, leaves the places from which all words of a run's
    least length agree. A stretch that an earlier lag found too has that smaller period: as it holds four of the larger
    ones, periods divide each other, and it is as long at both lags. For the same reason places within a known run of a
    smaller period, three lags long, can't belong to another run, so multiples of a period cost nothing.
    """
    n, planes = len(ids), None
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    starts = ends = np.empty(0, np.int64)
    order: list[tuple[int, int]] = []
    for lag, at in _possible(ids, n // times):
        if len(order) != len(starts):
            starts, ends = np.array([x for x, _ in order]), np.maximum.accumulate([y for _, y in order])
        if len(starts) and len(at):
            before = np.searchsorted(starts, at, "right") - 1
            at = at[(before < 0) | (ends[before] <= at + 3 * lag)]
        if not len(at):
            continue
        planes = planes or _planes(ids)
        differ = 0
        for plane in planes:
            differ |= plane ^ (plane >> lag)
        left, have, need = ~differ & ((1 << (n - lag)) - 1), 1, max(least, times * lag) - lag
        while have < need and left:
            step = min(have, need - have)
            left &= left >> step
            have += step
        if left:
            for a, b in zip(_ones(left & ~(left << 1)).tolist(), _ones(left & ~(left >> 1)).tolist()):
                length = b - a + need + lag
                if (a, length) not in known:
                    known.add((a, length))
                    found.append((a, length, lag))
                    insort(order, (a, a + length))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _planted(n: int, doc_id) -> np.ndarray | None:
    """Which original word stands at each place of a document whose end the contract makes periodic; None if it stays."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, least: int = 6) -> DataFrame:
    """For each row of docs: doc_id, n_words, runs (start, length, period by start, then period), and collapsed: the text's
    words joined by one space, each run cut to its first period.

    Words are what stands between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns, compared by
    their bytes. A run is a stretch with smallest period q, of max(least, 4*q) words or more, that no neighbouring word
    extends. With `planted` the ends of a tenth of the documents, chosen by id, are made periodic first (a null id: never).
    A null, empty or blank text has no words and no runs. Rows are judged one by one, so repeated rows and ids get the same
    answer each; no rows give none; other columns are ignored. A text is one row and is judged whole in memory that
    follows its length; lags that hold no run cost the reading of n/lag words.
    """
    own = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def judge(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, texts in text_slices(batch, "text"):
                counts, runs, kept = [], [], []
                for doc_id, text in zip(ids.slice(at, to - at).to_pylist(), texts):
                    words = (text or "").encode().split()
                    counts.append(len(words))
                    chosen = _planted(len(words), doc_id) if planted else None
                    if chosen is not None:
                        words = [words[i] for i in chosen.tolist()]
                    got = find_runs(_numbers(words), least) if len(words) >= least else []
                    if got:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in got:
                            gone[start + period] += 1
                            gone[start + length] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in got])
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())], names)

    kind = T.StructType([own.schema["doc_id"]]).add("n_words", "long").add("runs", T.ArrayType(_RUN)).add("collapsed", "string")
    return own.mapInArrow(judge, kind)


def digests(docs: DataFrame) -> DataFrame:
    """Of each document, its tenth planted: doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, planted=True)
    longest = F.expr("array_min(transform(runs, x -> struct(-x.length AS length, x.start AS start, x.period AS period)))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
