"""Digital twins: frames of station readings against an optimum, and a state that follows each twin."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import clamp
from strataform.operators.recurrent import Steps, fold

#: Frames that the basis is made from, that count as a neighbourhood, and whose steps give its radius.
WINDOW, NEAR, JUMPS = 64, 64, 32


def _off(stations: Column, station: str, optimum: dict[str, float]) -> list[Column]:
    """Squared deviations of a station's channels, by the size of their optimum."""
    cell = lambda ch: F.coalesce(F.try_element_at(F.try_element_at(stations, F.lit(station)), F.lit(ch)), F.lit(0.0))
    return [F.pow((cell(ch) - o) / max(1.0, abs(o)), 2) for ch, o in optimum.items()]


def distance(stations: Column, optimal: dict[str, dict[str, float]]) -> Column:
    """How far a frame (a map of maps) is from the optimum: root of the mean squared deviation over all channels that have one; 0 without any."""
    parts = [x for s, o in optimal.items() for x in _off(stations, s, o)]
    return F.sqrt(sum(parts, F.lit(0.0)) / len(parts)) if parts else F.lit(0.0)


def station_loads(stations: Column, optimal: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """(loads: a map of each station's deviation, 1 at most, by the largest of them; the station that is furthest off, null up to 0.15)."""
    raw = {s: F.sqrt(sum(_off(stations, s, o), F.lit(0.0)) / max(1, len(o))) for s, o in optimal.items()}
    most = F.greatest(F.lit(1e-6), *(clamp(v) for v in raw.values()))
    loads = F.create_map(*(c for s, v in raw.items() for c in (F.lit(s), clamp(v) / most)))
    worst = F.greatest(F.lit(-1.0), *raw.values())
    return loads, F.when(worst > 0.15, F.coalesce(*(F.when(v == worst, F.lit(s)) for s, v in raw.items())))


def drift_from_first(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with drift: how far each value is from its key's first one."""
    return df.withColumn("drift", F.col(value) - F.first(value).over(Window.partitionBy(key).orderBy(order)))


def novelty(df: DataFrame, key: str, order: str, value: str, radius: float | None = None, last: int = NEAR) -> DataFrame:
    """df with novelty: the distance of each value to the nearest of its key's `last` before; with a radius, as a share of twice that (0.2 at least), 1 at most. Null for a first value."""
    before = F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1))
    near = F.array_min(F.transform(F.col("_before"), lambda x: F.abs(F.col(value) - x)))
    share = near if radius is None else F.when(near.isNotNull(), clamp(near / (2 * max(0.2, radius))))
    return df.withColumn("_before", before).withColumn("novelty", share).drop("_before")


def twin_steps(dims: int = 6, warm_up: int = 16, alpha: float = 0.15, ahead: int = 12, kept: int = 512) -> Steps:
    """Of (raw, distance): latent, drift_sigma, efficiency, anomaly, forecast_distance and headroom of each frame.

    Frames are standardised by the running mean and deviation; every eight frames, after a warm-up, the main directions
    of the last WINDOW standardised frames become the basis that later ones are projected on. drift: the smoothed change
    of the distance. anomaly: the distance to the nearest of the last NEAR latent frames, by twice the ninth decile of
    recent steps. forecast_distance: along the trend of the last four frames before this one.
    """

    def step(state, _, raw, far):
        n, mean, m2, window, basis, age, drift, radius, past = state
        x = np.asarray(raw, dtype=float)
        n += 1
        off = x - mean
        mean = mean + off / n
        m2 = m2 + off * (x - mean)
        std = (x - mean) / np.maximum(1e-6, np.sqrt(m2 / (n - 1)) if n > 1 else 1.0)
        window = [*window, std][-WINDOW:]
        if n >= warm_up and (basis is None or age >= 8):
            w = np.array(window)
            values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(w.T, bias=True)))
            top = vectors[:, np.argsort(-values, kind="stable")[:dims]]
            basis, age = (top * np.where(top[np.abs(top).argmax(axis=0), range(top.shape[1])] < 0, -1, 1)).T, 0
        else:
            age += 1
        latent = basis @ std if basis is not None else np.zeros(min(dims, len(x)))
        drift = (1 - alpha) * drift + alpha * (abs(far - past[-1][1]) if past else 0.0)
        sigma = drift / max(1e-6, far * 0.05 + 0.1)
        efficiency = min(1.0, max(0.0, 1 - far / max(1.0, 1 + far)))
        odd = 0.0
        if len(past) >= 8:
            nearest = min(float(np.linalg.norm(latent - p)) for p, _ in past[-NEAR:])
            odd = min(1.0, nearest / (2 * max(0.2, radius)))
        tail = past[-4:]
        trend = (tail[-1][1] - tail[0][1]) / max(1, len(tail) - 1) if len(tail) > 1 else 0.0
        headroom = min(1.0, max(0.0, 0.6 * (1 - efficiency) + 0.4 * min(1.0, sigma / 3)))
        past = [*past, (latent, far)][-kept:]
        radius = 0.5
        if len(past) >= 8:
            first = max(1, len(past) - JUMPS)
            jumps = sorted(float(np.linalg.norm(b[0] - a[0])) for a, b in zip(past[first - 1 :], past[first:]))
            radius = jumps[math.floor(len(jumps) * 0.9)] or 0.5
        row = (latent.tolist(), sigma, efficiency, odd, [max(0.0, far + trend * h) for h in range(1, ahead + 1)], headroom)
        return (n, mean, m2, window, basis, age, drift, radius, past), [row]

    return Steps(lambda: (0, 0.0, 0.0, [], None, 0, 0.0, 0.5, []), step, "latent array<double>, drift_sigma double, efficiency double, anomaly double, forecast_distance array<double>, headroom double")


def twin_states(df: DataFrame, twin: str, t: str, raw: str, far: str, **steps) -> DataFrame:
    """(twin, t, latent, drift_sigma, efficiency, anomaly, forecast_distance, headroom) of twin_steps()."""
    return fold(df, twin, t, [raw, far], twin_steps(**steps))
