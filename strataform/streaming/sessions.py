"""Sessions and silences of keys in a stream, with rows out of order, late rows told apart, and state that ends.

A key's clock is the latest time that it has sent, less the lateness that is allowed; what a session holds doesn't
depend on how rows fall into batches, so a table gives the same as a stream of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

_OPEN = "first double, last double, n bigint, total double"
_OUT = "kind string, first double, last double, n bigint, total double"


def step(open_: list[tuple], clock: float, t: float, value: float, gap: float, lateness: float) -> tuple[list[tuple], float, list[tuple]]:
    """(open sessions, clock, what is told) after a row: sessions (first, last, n, total) that no row in time can reach any more, or the row itself if it comes later than it may."""
    if t < clock - lateness:
        return open_, clock, [("late", t, t, 1, value)]
    met = [s for s in open_ if s[0] - gap <= t <= s[1] + gap]
    rest = [s for s in open_ if not s[0] - gap <= t <= s[1] + gap]
    joined = (min([t, *(s[0] for s in met)]), max([t, *(s[1] for s in met)]), 1 + sum(s[2] for s in met), value + sum(s[3] for s in met))
    clock = max(clock, t)
    now = sorted([*rest, joined])
    return [s for s in now if s[1] + gap >= clock - lateness], clock, [("session", *s) for s in now if s[1] + gap < clock - lateness]


class Sessions(StatefulProcessor):
    """step() over the rows of a key as they come. A key that is silent for `idle` milliseconds of the cluster's time gives its open sessions, and its state goes."""

    def __init__(self, gap: float, lateness: float, idle: int | None):
        self.gap, self.lateness, self.idle = gap, lateness, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.clock = handle.getValueState("clock", "t double")

    def _told(self, key, rows) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "kind", "first", "last", "n", "total"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, clock, told = [tuple(x) for x in self.open.get()], float("-inf"), []
        if self.clock.exists():
            clock = self.clock.get()[0]
        for frame in rows:
            for t, value in zip(frame["t"].tolist(), frame["value"].tolist()):
                held, clock, more = step(held, clock, t, value, self.gap, self.lateness)
                told += more
        self.open.put(held) if held else self.open.clear()
        self.clock.update((clock,))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield from self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [("session", *x) for x in self.open.get()]
        self.open.clear()
        self.clock.clear()
        yield from self._told(key, held)

    def close(self) -> None:
        pass


def live_sessions(rows: DataFrame, key: str, t: str, value: str, gap: float, lateness: float, idle: int | None = None) -> DataFrame:
    """(key, kind, first, last, n, total) of a stream: sessions (kind `session`) of rows at most `gap` seconds apart, and rows that come
    more than `lateness` behind their key's latest (kind `late`), for a side table. A session is told once no row in time
    can reach it, or its key was silent for `idle` milliseconds. Rows whose key or time is null are left out, a null
    value counts as 0; t: seconds or a timestamp. State: the open sessions of each key, a few by lateness and gap. The
    session's state store must be RocksDB's."""
    own = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value")).filter("key IS NOT NULL AND t IS NOT NULL")
    kind = own.schema["key"].dataType.simpleString()
    return own.groupBy("key").transformWithStateInPandas(Sessions(gap, lateness, idle), f"key {kind}, {_OUT}", "append", "ProcessingTime" if idle is not None else "None")


def sessions(rows: DataFrame, key: str, t: str, value: str, gap: float, order: str | None = None, lateness: float = float("inf")) -> DataFrame:
    """(key, kind, first, last, n, total) of a table: all sessions, and the late rows of those that came in `order` (none without a bound).

    Each key's rows stream through a task in order, which holds the sessions that are open."""
    own = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), (F.col(order) if order else F.col(t)).alias("_order")).filter("key IS NOT NULL AND t IS NOT NULL")
    kind = own.schema["key"].dataType.simpleString()

    def run(batches):
        last, held, clock = None, [], float("-inf")
        for batch in batches:
            out = []
            for k, at, v in zip(*(batch.column(c).to_pylist() for c in ("key", "t", "value"))):
                if k != last:
                    out += [(last, "session", *s) for s in held]
                    last, held, clock = k, [], float("-inf")
                held, clock, told = step(held, clock, at, v, gap, lateness)
                out += [(k, *x) for x in told]
            yield shaped(out, batch.schema.field("key").type)
        yield shaped([(last, "session", *s) for s in held], own_type)

    def shaped(out, key_type):
        kinds = (key_type, pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["key", "kind", "first", "last", "n", "total"])

    own_type = to_arrow_type(own.schema["key"].dataType)
    return own.repartition("key").sortWithinPartitions("key", "_order", "t", "value").mapInArrow(run, f"key {kind}, {_OUT}")


def silences(rows: DataFrame, key: str, t: str, limit: float) -> DataFrame:
    """(key, since, until) of every silence of a key of more than `limit` seconds between two rows of a table; its last row's until is null."""
    own = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("since")).filter("key IS NOT NULL AND since IS NOT NULL").distinct()
    told = own.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))
    return told.filter((F.col("until") - F.col("since") > limit) | F.col("until").isNull())
