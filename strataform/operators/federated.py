"""Linear models trained by clients apart and averaged, from each client's sums alone."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.tables import cut


def _seed(client, seed: int) -> int:
    return zlib.crc32(repr((client, seed)).encode())


def client_sums(df: DataFrame, client: str, features: list[str], label: str) -> DataFrame:
    """(client, n, moments): the sums of all products of the features, 1 and the label, row by row of the upper triangle. One aggregation; a client of any size adds up map-side."""
    parts = [*(F.col(x).cast("double") for x in features), F.lit(1.0), F.col(label).cast("double")]
    products = [F.sum(parts[i] * parts[j]) for i in range(len(parts)) for j in range(i, len(parts))]
    full = df.dropna(subset=[client, *features, label])
    return full.groupBy(F.col(client).alias("client")).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("moments"))


def _unpack(moments, d: int) -> np.ndarray:
    m = np.zeros((d + 2, d + 2))
    m[np.triu_indices(d + 2)] = moments
    return m + np.triu(m, 1).T


def local_updates(sums: DataFrame, weights: list[float], epochs: int = 3, rate: float = 0.05, clip: float = 1.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(client, n, loss_before, loss_after, norm, delta): each client's steps down the gradient of its mean squared error from common weights (the last is the bias), clipped to a norm, with Gaussian noise.

    A step uses all of a client's rows, through their sums, so a client costs the same whatever its size.
    """
    w0 = np.array(weights, dtype=float)
    d = len(w0) - 1

    def train(batches):
        for batch in batches:
            rows = []
            for client, n, moments in zip(*(c.to_pylist() for c in batch.columns)):
                m = _unpack(moments, d)
                a, b, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
                loss = lambda w, a=a, b=b, yy=yy, n=n: float((yy - 2 * w @ b + w @ a @ w) / max(1, n))
                w = w0.copy()
                for _ in range(epochs):
                    w -= rate * (a @ w - b) / n
                delta = w - w0
                delta *= min(1.0, clip / max(1e-9, float(np.linalg.norm(delta))))
                norm = float(np.linalg.norm(delta))
                if noise:
                    delta = delta + np.random.default_rng(_seed(client, seed)).normal(0, noise, d + 1)
                rows.append((loss(w0), loss(w0 + delta), norm, delta.tolist()))
            out = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["client", "n", "loss_before", "loss_after", "norm", "delta"])

    return sums.mapInArrow(train, f"client {sums.schema['client'].dataType.simpleString()}, n bigint, loss_before double, loss_after double, norm double, delta array<double>")


def averaged(updates: DataFrame, weights: list[float], server_rate: float = 1.0) -> list[float]:
    """The next common weights: the plain average of the clients' updates added. One row reaches the driver."""
    row = updates.agg(*(F.avg(F.col("delta")[i]).alias(f"d{i}") for i in range(len(weights)))).first()
    return [w + server_rate * (row[i] or 0.0) for i, w in enumerate(weights)]


def federated(df: DataFrame, client: str, features: list[str], label: str, rounds: int = 3, weights: list[float] | None = None, server_rate: float = 1.0, epsilon: float = 0.5, budget: float = 10.0, **local) -> DataFrame:
    """(round, loss, norm, epsilon_spent, budget_left, weights) after each round: training, clipping, noise, averaging, and the mean squared error over all rows. A row a round."""
    spark = df.sparkSession
    sums = cut(client_sums(df, client, features, label))
    d = len(features)
    w, rows = list(weights or [0.0] * (d + 1)), []
    total = sums.agg(F.sum("n").alias("n"), *(F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range((d + 2) * (d + 3) // 2))).first()
    whole = _unpack([total[f"m{i}"] or 0.0 for i in range((d + 2) * (d + 3) // 2)], d)
    for k in range(1, rounds + 1):
        new = averaged(local_updates(sums, w, seed=k, **local), w, server_rate)
        step = float(np.linalg.norm(np.subtract(new, w)) / max(server_rate, 1e-12))
        w = new
        v = np.array([*w, -1.0])
        rows.append((k, float(v @ whole @ v / max(1, total["n"] or 0)), step, epsilon * k, max(0.0, budget - epsilon * k), w))
    return spark.createDataFrame(rows, "round int, loss double, norm double, epsilon_spent double, budget_left double, weights array<double>")
