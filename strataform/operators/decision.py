"""Scores, constraints, fronts and structural checks."""

from __future__ import annotations

import bisect
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import clamp, ratio
from strataform.operators.ordered import beside, numbered
from strataform.tables import cut


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail; a check that is null is ignored."""
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values()) or 1.0
    return sum((s * (weights[k] / total) for k, s in scores.items()), F.lit(0.0))


def feasible_first(df: DataFrame, feasible: str, score: str, tie: str, key: str | None = None) -> DataFrame:
    """df with rank: feasible rows first, then by score, then by id; within `key` if one is given."""
    order = (F.desc(feasible), F.desc(score), F.col(tie))
    if key is None:
        return numbered(df, *order).withColumn("rank", (F.col("_n") + 1).cast("int")).drop("_n")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


#: Rows of fronts that one task compares.
FRONT = 100_000


def _front(x: np.ndarray) -> np.ndarray:
    """Which rows nothing dominates, least is best: in order of their sums, each against the front so far. Equal rows stay."""
    order = np.lexsort((*x.T[::-1], x.sum(axis=1)))
    held, n, keep = np.empty((64, x.shape[1])), 0, np.zeros(len(x), dtype=bool)
    for i in order:
        front = held[:n]
        if not ((front <= x[i]).all(axis=1) & (front < x[i]).any(axis=1)).any():
            keep[i] = True
            if n == len(held):
                held = np.concatenate((held, np.empty_like(held)))
            held[n] = x[i]
            n += 1
    return keep


def pareto_front(df: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows that no other is at least as small as in every objective and smaller in one; equal rows all stay, rows with a null go.

    Each task drops what its own rows dominate. What is left, fronts and not rows, meets in one task if it fits, else
    block by block.
    """
    def local(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.filter(pa.array(_front(np.column_stack([held.column(c).to_numpy().astype(float) for c in objectives]))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = cut(df.dropna(subset=objectives).mapInArrow(local, df.schema))
    n = rows.count()
    if n <= FRONT:
        return rows.repartition(1).mapInArrow(local, df.schema)
    return _undominated(rows, objectives, -(-n // FRONT))


def _undominated(rows: DataFrame, objectives: list[str], n: int) -> DataFrame:
    """The rows that none dominates, by comparing blocks of them two by two, each pair of blocks in a task of its own."""
    own = cut(rows.withColumn("_row", F.monotonically_increasing_id()))

    def pack(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy().astype("<f8") for c in objectives])
        return pa.table({"block": table.column("block").slice(0, 1), "ids": [table.column("_row").to_numpy().astype("<i8").tobytes()], "x": [x.tobytes()]})

    blocks = cut(own.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, x binary"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks.select(F.col("block").alias("other"), F.col("x").alias("y")), "other")

    def beaten(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[c], "<f8").reshape(-1, len(objectives)) for c in ("x", "y"))
                y = y[_front(y)]
                off = np.array([((y <= v).all(axis=1) & (y < v).any(axis=1)).any() for v in x], dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], "<i8")[off])], ["_row"])

    gone = pairs.select("ids", "x", "y").mapInArrow(beaten, "_row bigint").distinct()
    return own.join(gone, "_row", "left_anti").drop("_row")


#: Points that one step of a sweep takes in.
SWEEP = 1 << 21


def _swept(points: DataFrame) -> DataFrame:
    """(a, b, front) of distinct points (a, b): their fronts, in one pass over ranges of the order by a, then b.

    What comes before a point in that order dominates it if its b isn't larger, so the point is in the first front whose
    least b so far is larger. The fronts' least b are all that a range hands on to the next one, as a table; they and
    the range's points are what a task holds.
    """
    placed = numbered(points, "a", "b").withColumn("_step", F.floor(F.col("_n") / SWEEP).cast("int"))
    folder = cut(placed.repartition("_step"), "_step")
    steps = -(-folder.count() // SWEEP)
    kind = "a double, b double, front int, told boolean"

    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        least = right.sort_by("front").column("b").to_pylist()
        left = left.sort_by([("a", "ascending"), ("b", "ascending")])
        fronts = []
        for b in left.column("b").to_pylist():
            k = bisect.bisect_right(least, b)
            if k == len(least):
                least.append(b)
            else:
                least[k] = b
            fronts.append(k)
        n = len(fronts)
        return pa.table({"a": pa.concat_arrays([left.column("a").combine_chunks(), pa.nulls(len(least), pa.float64())]), "b": pa.concat_arrays([left.column("b").combine_chunks(), pa.array(least, pa.float64())]), "front": pa.array([*fronts, *range(len(least))], pa.int32()), "told": pa.array([True] * n + [False] * len(least))})

    out, stairs = None, points.sparkSession.createDataFrame([], kind)
    for k in range(steps):
        own = folder.filter(F.col("_step") == k).select(F.lit(0).alias("_k"), "a", "b")
        done = cut(own.groupBy("_k").cogroup(stairs.withColumn("_k", F.lit(0)).groupBy("_k")).applyInArrow(sweep, kind))
        stairs, told = done.filter("NOT told"), done.filter("told").select("a", "b", "front")
        out = told if out is None else out.unionByName(told)
    return out if out is not None else stairs.select("a", "b", "front")


def front_ranks(df: DataFrame, row_id: str, objectives: list[str], most: int | None = None) -> DataFrame:
    """(row_id, front): the front that each row is in once those before it are taken away, from 0; rows beyond `most` fronts, if given, have -1.

    Two objectives are swept in order, each distinct point once, in as many steps as there are ranges of points. Of
    more objectives one front after another is peeled off, and each round writes what is left.
    """
    if len(objectives) == 2:
        own = df.dropna(subset=objectives).select(row_id, *(F.col(c).cast("double").alias(n) for c, n in zip(objectives, "ab")))
        front = F.col("front") if most is None else F.when(F.col("front") < most, F.col("front")).otherwise(-1)
        return own.join(_swept(own.select("a", "b").distinct()), ["a", "b"]).select(row_id, front.cast("int").alias("front"))
    left, out = cut(df.dropna(subset=objectives).select(row_id, *objectives)), None
    for n in count() if most is None else range(most):
        front = cut(pareto_front(left, objectives).select(row_id))
        part = front.withColumn("front", F.lit(n))
        out = part if out is None else out.unionByName(part)
        done = front.withColumnRenamed(row_id, "_done")
        left = cut(left.join(done, F.col(row_id).eqNullSafe(F.col("_done")), "left_anti"))
        if left.isEmpty():
            return out
    return out.unionByName(left.select(row_id, F.lit(-1).alias("front")))


def crowding(front: DataFrame, row_id: str, objectives: list[str]) -> DataFrame:
    """(row_id, crowding): the gaps between each row's neighbours by every objective, as shares of its range; ends have infinity."""
    parts = []
    spans = front.agg(*(F.max(c).alias(f"h{i}") for i, c in enumerate(objectives)), *(F.min(c).alias(f"l{i}") for i, c in enumerate(objectives))).first()
    for i, c in enumerate(objectives):
        span = float(spans[f"h{i}"] - spans[f"l{i}"]) if spans[f"h{i}"] is not None else 0.0
        gap = (F.col("_after") - F.col("_before")) / span if span > 0 else F.lit(0.0)
        end = F.col("_after").isNull() | F.col("_before").isNull()
        parts.append(beside(front.select(row_id, c), c, c, row_id).select(row_id, F.when(end, float("inf")).otherwise(gap).alias("part")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(row_id).agg(F.sum("part").alias("crowding"))


#: A device class's GFLOP/s, power (W), and grams of CO2 a kWh.
DEVICES = (("cpu_laptop", 60.0, 28.0, 380.0), ("cpu_server", 450.0, 220.0, 320.0), ("gpu_consumer", 8000.0, 320.0, 380.0), ("gpu_datacenter", 24000.0, 400.0, 240.0))


def rank_devices(df: DataFrame, work: str, limit_s: str, row_id: str) -> DataFrame:
    """(row_id, device, seconds, grams, feasible, rank) of each piece of work (GFLOP) on each of four devices: those in time first, then by CO2."""
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("device"), F.lit(g).alias("gflops"), F.lit(w).alias("watts"), F.lit(c).alias("intensity")) for n, g, w, c in DEVICES)))
    own = df.select(row_id, work, limit_s, kinds.alias("d")).select(row_id, work, limit_s, "d.*")
    own = own.withColumn("seconds", F.col(work) / F.col("gflops")).withColumn("grams", F.col("seconds") * F.col("watts") / 3.6e6 * F.col("intensity")).withColumn("feasible", F.col("seconds") <= F.col(limit_s))
    w = Window.partitionBy(row_id).orderBy(F.desc("feasible"), "grams", "device")
    return own.withColumn("rank", F.row_number().over(w)).select(row_id, "device", "seconds", "grams", "feasible", "rank")


#: What each part of a recommendation counts.
WEIGHTS = {"performance": 0.35, "cost": 0.2, "weight": 0.15, "sustainability": 0.15, "fatigue": 0.15}


def recommend(df: DataFrame, row_id: str, checks: dict[str, Column], weights: dict[str, float] = WEIGHTS, design_stress: float = 0.0) -> DataFrame:
    """df (yield, modulus, density, cost, co2, fatigue_limit) with violations, feasible, score and rank.

    Five parts between 0 and 1, relative to the largest values of all rows: strength against the design stress (4
    times is full) and stiffness by weight; low cost; low density; low CO2; fatigue limit against twice the stress (a
    third of the yield without one). One row of maxima is joined.
    """
    c = F.col
    stiff = c("modulus") / F.greatest(F.lit(0.01), c("density"))
    top = df.agg(F.max("cost").alias("_cost"), F.max("co2").alias("_co2"), F.max("density").alias("_density"), F.max(stiff).alias("_stiff"))
    own = df.crossJoin(F.broadcast(top))  # one row
    strength = clamp(c("yield") / design_stress / 4) if design_stress > 0 else F.lit(1.0)
    stress = F.lit(float(design_stress)) if design_stress > 0 else c("yield") / 3
    parts = {
        "performance": 0.65 * strength + 0.35 * clamp(stiff / c("_stiff")),
        "cost": clamp(1 - c("cost") / F.greatest(F.lit(1.0), c("_cost"))),
        "weight": clamp(1 - c("density") / F.greatest(F.lit(0.5), c("_density"))),
        "sustainability": clamp(1 - c("co2") / F.greatest(F.lit(0.5), c("_co2"))),
        "fatigue": clamp(c("fatigue_limit") / F.greatest(F.lit(1.0), stress * 2)),
    }
    own = own.withColumn("violations", violations(checks)).withColumn("feasible", F.size("violations") == 0).withColumn("score", weighted(parts, weights))
    return own.drop("_cost", "_co2", "_density", "_stiff")


def confidence(parts: dict[str, tuple[Column, float]]) -> Column:
    return weighted({k: clamp(c) for k, (c, _) in parts.items()}, {k: w for k, (_, w) in parts.items()})
