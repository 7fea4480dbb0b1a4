"""Curve fits by series: a damped oscillator by Levenberg-Marquardt from several starts, one grouped task a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Stiffness, damping, mass and amplitude: bounds.
BOUNDS = np.array([[1.0, 200.0], [0.01, 10.0], [0.05, 5.0], [0.1, 3.0]])


def oscillator(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    k, c, m, a = p
    decay = c / (2 * m)
    return a * np.exp(-decay * t) * np.cos(np.sqrt(np.maximum(1e-9, k / m - decay * decay)) * t)


def halton(n: int, base: int) -> np.ndarray:
    """The first n points of a low-discrepancy sequence."""
    out = np.zeros(n)
    for i in range(n):
        f, k = 1.0, i + 1
        while k:
            f /= base
            out[i] += f * (k % base)
            k //= base
    return out


def fit(t: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, float, int]:
    """(parameters, sum of squares, rounds): steps that lower the sum are taken and the damping eased, others make it heavier; parameters stay in bounds."""
    p, damping = np.clip(start, *BOUNDS.T), 1e-2
    best = float(((y - oscillator(p, t)) ** 2).sum())
    width = np.maximum((BOUNDS[:, 1] - BOUNDS[:, 0]) * 1e-4, 1e-6)
    for n in range(1, rounds + 1):
        jac = np.column_stack([(oscillator(p + w, t) - oscillator(p - w, t)) / (2 * w[i]) for i, w in enumerate(np.diag(width))])
        r = y - oscillator(p, t)
        normal = jac.T @ jac
        new = np.clip(p + np.linalg.lstsq(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), jac.T @ r, rcond=None)[0], *BOUNDS.T)
        value = float(((y - oscillator(new, t)) ** 2).sum())
        if value < best:
            done = best - value < 1e-12 * max(1.0, best)
            p, best, damping = new, value, max(1e-9, damping / 3)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return p, best, n


def calibrate(df: DataFrame, series: str, t: str = "t", y: str = "y", starts: int = 12) -> DataFrame:
    """(series, k, c, m, a, rss, r2, rounds) of each series' best fit. The frequency and decay alone are determined, so k, c and m are known up to a common factor."""
    points = BOUNDS[:, 0] + np.column_stack([halton(starts, b) for b in (2, 3, 5, 7)]) * (BOUNDS[:, 1] - BOUNDS[:, 0])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.dropna(subset=[t, y])
        a, b = own[t].to_numpy(float), own[y].to_numpy(float)
        if len(a) < 4:
            return pd.DataFrame({series: frame[series].iloc[:1], **{x: [None] for x in ("k", "c", "m", "a", "rss", "r2")}, "rounds": [0]})
        p, rss, n = min((fit(a, b, s) for s in points), key=lambda x: x[1])
        spread = float(((b - b.mean()) ** 2).sum())
        return pd.DataFrame({series: frame[series].iloc[:1], "k": p[0], "c": p[1], "m": p[2], "a": p[3], "rss": rss, "r2": 1 - rss / spread if spread > 0 else 0.0, "rounds": n})

    return df.groupBy(series).applyInPandas(run, f"{series} {df.schema[series].dataType.simpleString()}, k double, c double, m double, a double, rss double, r2 double, rounds int")
