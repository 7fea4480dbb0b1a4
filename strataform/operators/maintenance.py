"""Condition of assets from their sensor readings: packing, drift, novelty, risk, horizon and priority."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import finite
from strataform.operators.recurrent import Steps, ewma_step, fold

#: What each part of the risk counts.
WEIGHTS = {"drift": 0.45, "failure": 0.3, "optimal": 0.15, "trajectory": 0.1}
WARM_UP = 24


def pack(df: DataFrame, asset: str, t: str, readings: str, channels: list[str]) -> DataFrame:
    """(asset, t, vector): the channels of a map of readings in a fixed order; one that is missing or not finite is the asset's mean so far, or 0."""
    w = Window.partitionBy(asset).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select(asset, t, *(F.when(finite(F.col(readings)[c]), F.col(readings)[c]).alias(f"_{i}") for i, c in enumerate(channels)))
    return own.select(asset, t, F.array(*(F.coalesce(F.col(f"_{i}"), F.avg(f"_{i}").over(w), F.lit(0.0)) for i in range(len(channels)))).alias("vector"))


def priority(risk: Column) -> Column:
    return F.when(risk >= 0.85, "urgent").when(risk >= 0.6, "schedule").when(risk >= 0.35, "watch").otherwise("ok")


def risk_steps(failures: dict | None = None, optimal: dict | None = None, trajectories: dict | None = None, window: int = 16, alpha: float = 0.05, k: float = 3.0) -> Steps:
    """Of (asset, vector): sigma, to_optimal, to_failure, risk and horizon of every reading, in order.

    sigma: deviation from the asset's running mean, the reading included. It is set against an adaptive threshold; the
    distances to known optimal and failed states (-1 without any failed ones), and of the last `window` readings to the
    ends of known failing series, count as well. Risk is cut to three tenths in the first WARM_UP readings. horizon:
    how long at the smoothed rate of change until the risk is 1. failures, optimal and trajectories: states, or series
    of them, by asset, from an operator's log: a bounded list each. Readings pass in order of time; a task holds an
    asset's sums and its last `window` readings.
    """
    known = [{a: np.array(v, dtype=float) for a, v in (x or {}).items()} for x in (failures, optimal)]
    series = {a: [np.array(v, dtype=float) for v in x if len(v) >= window] for a, x in (trajectories or {}).items()}

    def step(state, now, name, x):
        n, mean, m2, smooth, tail, rate, last_risk, last_t = state
        bad, good = (x_.get(name, ()) for x_ in known)
        x = np.asarray(x, dtype=float)
        n += 1
        off = x - mean
        mean = mean + off / n
        m2 = m2 + off * (x - mean)
        sigma = 0.0 if n < 2 else float(np.sqrt(np.mean((x - mean) ** 2 / np.maximum(1e-9, m2 / (n - 1)))))
        smooth = ewma_step(smooth, sigma, alpha)
        scale = max(1e-3, smooth[0] + 1e-3)
        tail = [*tail, x][-window:]
        nearest = lambda states: float(np.sqrt(((states - x) ** 2).sum(axis=1)).min())
        to_good, to_bad = nearest(good) if len(good) else 0.0, nearest(bad) if len(bad) else -1.0
        parts = {"drift": min(1.0, sigma / max(1e-3, smooth[0] + k * math.sqrt(smooth[1]))), "optimal": min(1.0, to_good / scale), "failure": max(0.0, 1 - to_bad / (2 * scale)) if len(bad) else 0.0}
        if len(tail) == window and series.get(name):
            best = min(float(np.sqrt(((s[-window:] - np.array(tail)) ** 2).sum(axis=1)).mean()) for s in series[name])
            parts["trajectory"] = max(0.0, 1 - best / (2 * scale))
        risk = min(1.0, (0.3 if n < WARM_UP else 1.0) * sum(WEIGHTS[p] * v for p, v in parts.items()))
        rate = 0.7 * rate + 0.3 * (risk - last_risk) / max(1e-3, now - (last_t or now))
        horizon = max(1.0, (1 - risk) / rate) if rate > 1e-6 else math.inf
        return (n, mean, m2, smooth, tail, rate, risk, now), [(sigma, to_good, to_bad, risk, horizon)]

    return Steps(lambda: (0, 0.0, 0.0, None, [], 0.0, 0.0, 0.0), step, "sigma double, to_optimal double, to_failure double, risk double, horizon double")


def risk_series(df: DataFrame, asset: str, t: str, vector: str, **steps) -> DataFrame:
    """(asset, t, sigma, to_optimal, to_failure, risk, horizon, priority) of risk_steps()."""
    own = df.withColumn("_name", F.col(asset))
    return fold(own, asset, t, ["_name", vector], risk_steps(**steps)).withColumn("priority", priority(F.col("risk")))


def queue(scores: DataFrame, asset: str, t: str) -> DataFrame:
    """Each asset's latest score, the most pressing first."""
    w = Window.partitionBy(asset).orderBy(F.desc(t))
    level = F.when(F.col("priority") == "urgent", 3).when(F.col("priority") == "schedule", 2).when(F.col("priority") == "watch", 1).otherwise(0)
    return scores.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(F.desc(level), F.desc("risk"), asset)


def stacked(df: DataFrame, asset: str, t: str, vector: str, width: int) -> DataFrame:
    """df with stack: the last `width` vectors in a row, filled up with the first of them."""
    w = Window.partitionBy(asset).orderBy(t).rowsBetween(1 - width, 0)
    rows = F.collect_list(vector).over(w)
    return df.withColumn("_rows", rows).withColumn("stack", F.flatten(F.concat(F.array_repeat(F.col("_rows")[0], F.lit(width) - F.size("_rows")), "_rows"))).drop("_rows")
