"""Two-headed models as plain weights: training from sums, evaluation, importance and suggestions; fits from several starts put together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import clamp
from strataform.tables import cut


def linear(features: list[str], weights: list[float]) -> Column:
    """The features by weight, and the last weight as bias."""
    return sum((F.col(x) * float(w) for x, w in zip(features, weights)), F.lit(float(weights[-1])))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def predict(df: DataFrame, features: list[str], quality: list[float], defect: list[float]) -> DataFrame:
    """df with quality_hat, a number, and defect_hat, a chance."""
    return df.withColumn("quality_hat", linear(features, quality)).withColumn("defect_hat", logistic(linear(features, defect)))


def train(df: DataFrame, features: list[str], quality: str, defect: str, epochs: int = 30, rate: float = 0.1, momentum: float = 0.9) -> tuple[list[float], list[float]]:
    """(quality weights, defect weights) by gradient steps with momentum: squared error and cross entropy.

    A step is one aggregation over all rows, summed up map-side, and reaches the driver as one row of as many numbers
    as there are weights; rows that lack a feature or label teach nothing.
    """
    own = cut(df.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys((*features, quality, defect)))).dropna())
    n = own.count()
    w = np.zeros((2, len(features) + 1))
    v = np.zeros_like(w)
    for _ in range(epochs if n else 0):
        off = (linear(features, w[0]) - F.col(quality), logistic(linear(features, w[1])) - F.col(defect))
        row = own.agg(*(F.sum(e * (F.col(x) if x else F.lit(1.0))) for e in off for x in (*features, None))).first()
        v = momentum * v - rate * np.array(row, dtype=float).reshape(w.shape) / n
        w = w + v
    return w[0].tolist(), w[1].tolist()


def evaluate(df: DataFrame, quality: str, defect: str) -> DataFrame:
    """One row: n, mean squared error of quality_hat, cross entropy of defect_hat (kept 1e-6 from 0 and 1) and the share told right at a half."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("defect_hat")))
    y = F.col(defect).cast("double")
    off = F.col("quality_hat") - F.col(quality)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(off * off).alias("mse"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"), F.avg(F.when((F.col("defect_hat") >= 0.5) == (y >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"))


def importance(weights: DataFrame, feature: str, columns: list[str]) -> DataFrame:
    """(feature, importance): the size of a feature's weights, as a share of the largest. Weights are a row a feature, so few."""
    size = sum((F.abs(F.col(c)) for c in columns), F.lit(0.0))
    own = weights.select(feature, size.alias("_size"))
    top = F.broadcast(own.agg(F.max("_size").alias("_top")))  # one row
    return own.crossJoin(top).select(feature, F.when(F.col("_top") > 0, F.col("_size") / F.col("_top")).otherwise(0.0).alias("importance"))


def tweaks(df: DataFrame, row_id: str, features: list[str], quality: list[float], defect: list[float], step: float = 0.2, k: int = 3) -> DataFrame:
    """(row_id, feature, before, after, gain, rank): changes of one feature, along its slope, by `step` at most and within 0..1, that raise quality less defect by more than 1e-5; each row's k best."""
    p = F.col("defect_hat")
    rows = []
    for i, x in enumerate(features):
        slope = float(quality[i]) - p * (1 - p) * float(defect[i])
        to = clamp(F.col(x) + F.greatest(F.lit(-step), F.least(F.lit(step), slope)))
        rows.append(F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("before"), to.alias("after"), (slope * (to - F.col(x))).alias("gain")))
    own = predict(df, features, quality, defect).select(row_id, F.explode(F.array(*rows)).alias("t")).select(row_id, "t.*").filter("gain > 1e-5")
    w = Window.partitionBy(row_id).orderBy(F.desc("gain"), "feature")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def consensus(fits: DataFrame, series: str, rss: str, parameters: list[str], k: int = 3) -> DataFrame:
    """(series, n, <p>_mean, <p>_std) over the k fits of each series with the least rss; the deviation of a single fit is 0."""
    w = Window.partitionBy(series).orderBy(rss, *parameters)
    best = fits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return best.groupBy(series).agg(F.count(F.lit(1)).alias("n"), *(f for p in parameters for f in (F.avg(p).alias(f"{p}_mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias(f"{p}_std"))))
