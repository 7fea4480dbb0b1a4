"""Rounds over a partitioned state: a kernel per part, messages between parts, and totals folded between rounds.

What doesn't change is bucketed by part once and never shuffled again; a round shuffles states and messages alone,
and is written to the shared folder, so a lost executor costs the stage it was in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from strataform.operators.ordered import ranged
from strataform.tables import bucketed, cut, drop, large

#: kernel(round, part, fixed, state, inbox, totals) -> (state, messages with `to`, values for the totals)
Kernel = Callable[[int, object, pa.Table, pa.Table, pa.Table, dict], tuple[pa.Table, pa.Table, dict[str, float]]]
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def supersteps(fixed: DataFrame, state: DataFrame, messages: str, kernel: Kernel, folds: dict[str, str], most: int, until: Callable[[dict], bool] | None = None, inbox: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """(state, totals of every round): the kernel is called for every part and round, with the part's rows of fixed and state
    (both have `part`), the messages that came to it (columns `messages`), and the totals of the round before (none at first).

    It returns the part's state in the next round, messages with `to`, the part that each goes to, and values, which are
    folded over the parts by `folds` (sum, min, max). The totals also have `messages`, the number sent. Rounds end when
    until(totals) holds, or after `most`. A part whose rows don't fit into a task's memory must be cut; parts without
    rows and without messages aren't called. inbox: messages that are there before the first round, with `to`.
    """
    spark = fixed.sparkSession
    kind = dict(fixed.dtypes)["part"]
    of_state, of_message = state.drop("part").schema, spark.createDataFrame([], messages).schema
    schema = f"part {kind}, s {of_state.simpleString()}, m {of_message.simpleString()}, v map<string,double>"
    rows, n = bucketed(fixed, "part")
    none = F.lit(None).cast(of_message.simpleString())
    held = state.select("part", F.struct(*of_state.names).alias("s"), none.alias("m"), F.lit(None).cast("map<string,double>").alias("v"))
    if inbox is not None:
        held = held.unionByName(inbox.select(F.col("to").alias("part"), F.struct(*of_message.names).alias("m")), allowMissingColumns=True)
    held, log, totals = cut(held), [], {}
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def stepped(k: int, totals: dict):
        def unpacked(table: pa.Table, name: str) -> pa.Table:
            own = table.column(name).combine_chunks()
            own = own.filter(own.is_valid())
            return pa.Table.from_arrays(own.flatten(), schema=pa.schema(list(arrow.field(name).type)))

        def packed(part, name: str, table: pa.Table) -> pa.Table:
            to = arrow.field(name).type
            own = pa.StructArray.from_arrays([table.column(f.name).combine_chunks().cast(f.type) for f in to], fields=list(to))
            where = table.column("to").combine_chunks().cast(arrow.field("part").type) if name == "m" else pa.array([part] * len(own), arrow.field("part").type)
            parts = {"part": where, name: own}
            return pa.table([parts.get(f.name, pa.nulls(len(own), f.type)) for f in arrow], schema=arrow)

        def run(key, left, right):
            part = (key[0] if isinstance(key, tuple) else key).as_py()
            new, sent, values = kernel(k, part, left.drop_columns(["part"]), unpacked(right, "s"), unpacked(right, "m"), totals)
            told = pa.table([pa.array([part], arrow.field("part").type), pa.nulls(1, arrow.field("s").type), pa.nulls(1, arrow.field("m").type), pa.array([list({**values, "messages": float(sent.num_rows)}.items())], arrow.field("v").type)], schema=arrow)
            return pa.concat_tables([packed(part, "s", new), packed(part, "m", sent), told])

        return run

    for k in range(most):
        new = cut(rows.groupBy("part").cogroup(held.filter("v IS NULL").repartition(n, "part").groupBy("part")).applyInArrow(stepped(k, totals), schema))
        folded = new.filter("v IS NOT NULL").agg(*(FOLDS[f](F.col("v")[name]).alias(name) for name, f in {**folds, "messages": "sum"}.items())).first()  # one row
        drop(held)
        held, totals = new, folded.asDict()
        log.append(totals)
        if until and until(totals):
            break
    return held.filter("s IS NOT NULL").select("part", "s.*"), log


#: Keys and edges of parts that one task of a traversal takes in, about.
TOGETHER = 1 << 20


def _together(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (key, part) with parts that follow each other in their order made one up to TOGETHER keys and edges; a larger part stays."""
    spark = parts.sparkSession
    rows = parts.select("part", F.lit(1).alias("n")).unionByName(edges.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n")).join(large(parts), "key").select("part", "n"))
    sizes = ranged(rows.groupBy("part").agg(F.sum("n").alias("n")), "part")
    base, starts = 0, []
    for r in sizes.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():  # a row a range
        starts.append((r["_part"], base))
        base += r["n"]
    before = F.sum("n").over(Window.partitionBy("_part").orderBy("part")) - F.col("n") + F.col("_base")
    dealt = sizes.join(F.broadcast(spark.createDataFrame(starts, "_part int, _base bigint")), "_part").select("part", F.floor(before / TOGETHER).alias("_to"))
    return cut(parts.join(dealt, "part").select("key", F.col("_to").alias("part")))


def traversal(edges: DataFrame, parts: DataFrame, roots: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, list[dict]]:
    """((key, depth) of all that roots (key) reach along edges a -> b, at the fewest steps; totals of every round).

    parts: (key, part) of every key. Small parts that follow each other count as one, as much as a task takes in. Inside
    it a round goes as many steps as there are, and only depths of keys beyond its border are sent on: there are as many
    rounds as a shortest path crosses borders, and one or two more.
    """
    edges = cut(edges.select("a", "b").distinct())
    parts = large(_together(edges, parts.select("key", "part")))
    side = parts.select(F.col("key").alias("b"), F.col("part").alias("to"))
    fixed = edges.join(parts.select(F.col("key").alias("a"), "part"), "a").join(side, "b").select("part", "a", "b", "to")
    kind = dict(parts.dtypes)
    began = roots.select("key").distinct().join(parts, "key").select(F.col("part").alias("to"), "key", F.lit(0).alias("depth"))
    # A part without edges has no row in fixed, but keeps what comes to it.
    empty = parts.select("part", "key", F.lit(0).alias("depth")).limit(0)

    def kernel(k, part, table, state, inbox, totals):
        known = dict(zip(state.column("key").to_pylist(), state.column("depth").to_pylist()))
        by_depth: dict[int, set] = {}
        for key, depth in zip(inbox.column("key").to_pylist(), inbox.column("depth").to_pylist()):
            if depth < known.get(key, depth + 1):
                known[key] = depth
                by_depth.setdefault(depth, set()).add(key)
        beyond: dict = {}
        if by_depth:
            a = table.column("a").to_numpy(zero_copy_only=False)
            order = np.argsort(a, kind="stable")
            a, b, to = a[order], table.column("b").to_numpy(zero_copy_only=False)[order], table.column("to").to_numpy(zero_copy_only=False)[order]
            while by_depth:
                depth = min(by_depth)
                front = [x for x in by_depth.pop(depth) if known[x] == depth]
                lows, highs = np.searchsorted(a, front, "left"), np.searchsorted(a, front, "right")
                for low, high in zip(lows.tolist(), highs.tolist()):
                    for x, p in zip(b[low:high].tolist(), to[low:high].tolist()):
                        if p != part:
                            beyond[p, x] = min(depth + 1, beyond.get((p, x), depth + 1))
                        elif depth + 1 < known.get(x, depth + 2):
                            known[x] = depth + 1
                            by_depth.setdefault(depth + 1, set()).add(x)
        said = pa.table({"key": pa.array(known.keys(), inbox.schema.field("key").type), "depth": pa.array(known.values(), pa.int32())})
        sent = pa.table({"to": pa.array([p for p, _ in beyond], table.schema.field("to").type), "key": pa.array([x for _, x in beyond], inbox.schema.field("key").type), "depth": pa.array(beyond.values(), pa.int32())})
        return said, sent, {}

    found, log = supersteps(fixed, empty, f"key {kind['key']}, depth int", kernel, {}, most, lambda t: not t["messages"], began)
    return found.select("key", "depth"), log


def diffusion(edges: DataFrame, parts: DataFrame, values: DataFrame, rounds: int, keep: float = 0.0, give: float | None = None, until: float | None = None) -> tuple[DataFrame, list[dict]]:
    """((key, value) after rounds in which every key's value becomes keep times its own plus give times the sum of those it reads; totals).

    edges: a reads b; give: the mean of what is read if it is None. values: (key, value), 0 for others. A round sends a
    value once to each part that reads it. Rounds end early when no value changes by more than `until`. A key that reads
    nothing keeps its value.
    """
    own = edges.select("a", "b").distinct().join(parts.select(F.col("key").alias("a"), "part"), "a").join(parts.select(F.col("key").alias("b"), F.col("part").alias("home")), "b")
    reads = own.select("part", "a", "b", F.lit(None).cast(dict(parts.dtypes)["part"]).alias("to"))
    sends = own.filter("part <> home").select(F.col("home").alias("part"), F.lit(None).cast(dict(parts.dtypes)["key"]).alias("a"), "b", F.col("part").alias("to")).distinct()
    state = parts.join(values.select("key", F.col("value").cast("double").alias("value")), "key", "left").select("part", "key", F.coalesce("value", F.lit(0.0)).alias("value"))

    def kernel(k, part, table, held, inbox, totals):
        reads = pc.is_valid(table.column("a"))
        a, b = (table.filter(reads).column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        keys = held.column("key").to_numpy(zero_copy_only=False)
        value = held.column("value").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, value = keys[order], value[order]
        change = 0.0
        if k and len(a):  # the first round only sends
            seen = np.concatenate((keys, inbox.column("key").to_numpy(zero_copy_only=False)))
            known = np.concatenate((value, inbox.column("value").to_numpy()))
            by = np.argsort(seen, kind="stable")
            got = known[by][np.searchsorted(seen[by], b)]
            at = np.searchsorted(keys, a)
            sums, n = np.bincount(at, got, len(keys)), np.bincount(at, minlength=len(keys))
            new = np.where(n > 0, keep * value + (sums / np.maximum(n, 1) if give is None else give * sums), value)
            change, value = float(np.abs(new - value).max()), new
        far = table.filter(pc.invert(reads))
        b = far.column("b").to_numpy(zero_copy_only=False)
        sent = pa.table({"to": far.column("to"), "key": far.column("b"), "value": pa.array(value[np.searchsorted(keys, b)] if len(b) else np.empty(0))})
        return pa.table({"key": pa.array(keys, held.schema.field("key").type), "value": pa.array(value)}), sent, {"change": change if k else float("inf")}

    kind = dict(parts.dtypes)["key"]
    found, log = supersteps(reads.unionByName(sends), state, f"key {kind}, value double", kernel, {"change": "max"}, rounds + 1, None if until is None else lambda t: t["change"] <= until)
    return found.select("key", "value"), log
