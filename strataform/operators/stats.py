"""Regression from sums, scaling, residuals, counts with zeros, precision loss and iterative fits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.scalars import ratio
from strataform.tables import cut

RIDGE = 1e-3


def ridge_fit(df: DataFrame, channel: str, x: str, y: str, penalty: float = RIDGE) -> DataFrame:
    """(channel, n, scale, bias, rmse, sigma2, bias0): measured y from predicted x, by sums alone, so batches add up. A channel of under two rows, or with a singular system, is left out. The residual variance leaves the penalty out."""
    s = df.groupBy(F.col(channel).alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    c = F.col
    a, d = c("sxx") + penalty, c("n") + penalty
    det = a * d - c("sx") * c("sx")
    s = s.withColumn("det", det).filter((c("n") >= 2) & (F.abs("det") >= 1e-9))
    s = s.withColumn("scale", (d * c("sxy") - c("sx") * c("sy")) / c("det")).withColumn("bias", (a * c("sy") - c("sx") * c("sxy")) / c("det"))
    m, b = c("scale"), c("bias")
    ssr = c("syy") - 2 * m * c("sxy") - 2 * b * c("sy") + m * m * c("sxx") + 2 * m * b * c("sx") + b * b * c("n")
    s = s.withColumn("ssr", F.greatest(F.lit(0.0), ssr))
    return s.select("channel", "n", "scale", "bias", F.sqrt(c("ssr") / c("n")).alias("rmse"), F.greatest(F.lit(1e-9), c("ssr") / F.greatest(F.lit(1), c("n") - 2)).alias("sigma2"), ((c("sy") - c("sx")) / c("n")).alias("bias0"))


def ridge_apply(df: DataFrame, model: DataFrame, channel: str, x: str) -> DataFrame:
    """df with corrected: scale * x + bias of its channel, or x where the channel has no model. One row a channel is joined."""
    side = model.select(F.col("channel").alias("_channel"), "scale", "bias")
    return df.join(side, df[channel] == side["_channel"], "left").withColumn("corrected", F.coalesce(F.col("scale") * F.col(x) + F.col("bias"), F.col(x))).drop("_channel", "scale", "bias")


def residual_stats(df: DataFrame, channel: str, x: str, y: str, corrected: str) -> DataFrame:
    raw, now = F.col(y) - F.col(x), F.col(y) - F.col(corrected)
    out = df.groupBy(F.col(channel).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.avg(raw).alias("mean_raw"), F.sqrt(F.avg(raw * raw)).alias("rmse_raw"), F.avg(now).alias("mean_corrected"), F.sqrt(F.avg(now * now)).alias("rmse_corrected"))
    return out.withColumn("reduction", F.greatest(F.lit(0.0), ratio(F.col("rmse_raw") - F.col("rmse_corrected"), F.col("rmse_raw"))))


def scale_features(df: DataFrame, names: list[str], how: str = "minmax") -> DataFrame:
    """df with <name>_scaled: to 0..1 (0 for a range up to 1e-9), or to zero mean and unit sample deviation (a deviation of 0 counts as 1). One row of statistics is joined."""
    low, high = (F.min, F.max) if how == "minmax" else (F.avg, F.stddev_samp)
    stats = df.agg(*(f(n).cast("double").alias(f"_{k}_{n}") for n in names for k, f in (("a", low), ("b", high))))
    both = df.crossJoin(F.broadcast(stats))  # one row
    for n in names:
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        if how == "minmax":
            value = F.when(b - a > 1e-9, (F.col(n) - a) / (b - a)).otherwise(0.0)
        else:
            value = (F.col(n) - a) / F.when(b > 0, b).otherwise(1.0)
        both = both.withColumn(f"{n}_scaled", value)
    return both.select(*df.columns, *(f"{n}_scaled" for n in names))


def reduced(df: DataFrame, key: str, total: str, bounds: str, step: str, share: float, low: float, high: float) -> DataFrame:
    """(key, total, low, high, dt): the sum of a column, the least and largest of another, and the step that all agree on: the least of a third by `share`, kept within bounds. Partial results of tasks are merged."""
    dt = F.greatest(F.lit(low), F.least(F.lit(high), F.min(step) * share))
    return df.groupBy(key).agg(F.sum(total).alias("total"), F.min(bounds).alias("low"), F.max(bounds).alias("high"), dt.alias("dt"))


def cell_means(df: DataFrame, cells: dict[str, Column], value: str) -> DataFrame:
    """(cells, n, mean) of the rows of each cell."""
    return df.groupBy(*(c.alias(k) for k, c in cells.items())).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def counts_with_zeros(df: DataFrame, key: str, domain: DataFrame, domain_key: str) -> DataFrame:
    """How many rows each key of the domain has, 0 for those without."""
    n = df.groupBy(F.col(key).alias(domain_key)).agg(F.count(F.lit(1)).alias("n"))
    return domain.select(domain_key).join(n, domain_key, "left").select(domain_key, F.coalesce("n", F.lit(0)).alias("n"))


def log2_histogram(df: DataFrame, x: Column, bins: int = 10) -> DataFrame:
    return df.groupBy(F.least(F.lit(bins - 1), F.floor(F.log2(F.greatest(F.lit(1.0), x)))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def precision_loss(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, max_abs_loss, overflows) of storing each column in 32-bit floats."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).cast("double").alias("x")) for n in names))).alias("c")).select("c.*").filter("x IS NOT NULL")
    stored = F.col("x").cast("float").cast("double")
    return cells.groupBy("column_name").agg(F.max(F.when(F.abs(stored) < float("inf"), F.abs(F.col("x") - stored)).otherwise(0.0)).alias("max_abs_loss"), F.count_if(F.abs(stored) == float("inf")).alias("overflows"))


def _exactly(parts: list[float], x: float) -> list[float]:
    """parts and x as numbers that don't overlap and have the same sum, exactly."""
    out = []
    for p in parts:
        if abs(x) < abs(p):
            x, p = p, x
        high = x + p
        if not math.isfinite(high):
            return [high]
        low = p - (high - x)
        if low:
            out.append(low)
        x = high
    return [*out, x]


def exact_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total): the sum of a key's values, exact until it is rounded once, so the same however rows are dealt or ordered. Nulls are left out.

    Each task sends one row a key: a few numbers whose sum is exact, whatever went into it.
    """
    own = df.select(key, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).sortWithinPartitions(key)
    kind = df.schema[key].dataType.simpleString()

    def partial(batches):
        held, parts = (), []
        for batch in batches:
            out = []
            for k, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (k,) != held:
                    if held:
                        out.append((*held, parts))
                    held, parts = (k,), []
                parts = _exactly(parts, v)
            yield _rows(out, batch.schema.field(0).type)
        if held:
            yield _rows([(*held, parts)], batch.schema.field(0).type)

    def _rows(out, key_type):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], key_type), pa.array([r[1] for r in out], pa.list_(pa.float64()))], [key, "parts"])

    def total(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([math.fsum(x) if all(map(math.isfinite, x)) else sum(x) for x in batch.column(1).to_pylist()], pa.float64())], [key, "total"])

    parts = own.mapInArrow(partial, f"{key} {kind}, parts array<double>").groupBy(key).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return parts.mapInArrow(total, f"{key} {kind}, total double")


def pca(df: DataFrame, names: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, components, shares): of the standardised columns; sums over the table come from Spark, one row, and the small matrix is solved here."""
    n = len(names)
    full = df.dropna(subset=names)
    sums = full.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(n)])
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    dev = np.sqrt(np.diag(cov))
    dev = np.where(dev > 0, dev, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
    top = np.argsort(-values)[:k]
    vectors = vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top])  # the largest part of each is positive
    return mean, dev, vectors.T, values[top] / max(1e-12, values.sum())


def project(df: DataFrame, names: list[str], mean, dev, components) -> DataFrame:
    """df with latent, an array: the columns on the components."""
    parts = [sum(((F.col(c) - float(m)) / float(s)) * float(w) for c, m, s, w in zip(names, mean, dev, row)) for row in components]
    return df.withColumn("latent", F.array(*parts))


def spread_centres(df: DataFrame, names: list[str], row_id: str, k: int, seed: int = 1) -> list[list[float]]:
    """k rows as first centres: the first at random, each further one with a chance that grows with the square of its distance to the nearest so far. Each draw is one aggregation: of exponential waiting times, by a hash of the row and draw, the shortest wins."""
    centres: list[list[float]] = []
    for draw in range(k):
        u = (F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(draw)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        far = F.lit(1.0)
        if centres:
            far = F.least(*(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(names, row)) for row in centres)) if len(centres) > 1 else sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(names, centres[0]))
        wait = F.when(far > 0, -F.log(u) / far)
        row = df.dropna(subset=names).withColumn("_wait", wait).filter(F.col("_wait").isNotNull()).agg(F.min_by(F.struct(*names), F.struct("_wait", row_id)).alias("r")).first()["r"]
        if row is None:  # fewer different rows than centres
            break
        centres.append([float(row[c]) for c in names])
    return centres


def kmeans(df: DataFrame, names: list[str], centres: list[list[float]], rounds: int = 20) -> tuple[list[list[float]], DataFrame]:
    """Centres after some rounds of Lloyd's method, and df with cluster and squared distance. An empty cluster keeps its centre; of centres as near, the first. Each round is one aggregation of k rows."""

    def near(cs):
        far = F.array(*(F.struct(sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(names, row)).alias("d"), F.lit(i).alias("cluster")) for i, row in enumerate(cs)))
        return df.withColumn("_near", F.array_min(far)).withColumns({"cluster": F.col("_near.cluster"), "distance2": F.col("_near.d")}).drop("_near")

    centres = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        got = {r["cluster"]: [r[c] for c in names] for r in near(centres).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in names)).collect()}
        new = [got.get(i, c) for i, c in enumerate(centres)]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres, near(centres)


class Sketch:
    """Count, mean and the `rank` strongest directions of rows seen, scaled by their strength: (n, mean, rows of the sketch). Merges with others in any order."""

    def __init__(self, rank: int, n: float = 0.0, mean: np.ndarray | None = None, rows: np.ndarray | None = None):
        self.rank, self.n, self.mean, self.rows = rank, n, mean, rows

    def add(self, x: np.ndarray) -> Sketch:
        """The sketch with the rows of x taken in; rows that aren't finite are left out."""
        x = x[np.isfinite(x).all(axis=1)]
        if not len(x):
            return self
        mean = x.mean(axis=0)
        return self.merge(Sketch(self.rank, float(len(x)), mean, x - mean))

    def merge(self, other: Sketch) -> Sketch:
        """What both have seen: their directions and the one between their means, cut to the strongest by a singular value decomposition."""
        if not other.n or not self.n:
            return other.cut() if other.n else self
        n, apart = self.n + other.n, other.mean - self.mean
        between = np.sqrt(self.n * other.n / n) * apart[None, :]
        return Sketch(self.rank, n, self.mean + apart * (other.n / n), np.concatenate((self.rows, other.rows, between))).cut()

    def cut(self) -> Sketch:
        _, strength, directions = np.linalg.svd(self.rows, full_matrices=False)
        return Sketch(self.rank, self.n, self.mean, strength[: self.rank, None] * directions[: self.rank])

    def directions(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(k unit directions, their variances), strongest first; the largest part of each is positive."""
        if self.rows is None:
            return np.empty((0, 0)), np.empty(0)
        strength = np.linalg.norm(self.rows, axis=1)[:k]
        unit = self.rows[:k] / np.maximum(strength, 1e-300)[:, None]
        return unit * np.where(unit[np.arange(len(unit)), np.abs(unit).argmax(axis=1)] < 0, -1, 1)[:, None], strength**2 / max(1.0, self.n - 1)


def effective_dimension(variances: np.ndarray) -> float:
    """The participation ratio of a spectrum: how many directions carry it; 0 if none does."""
    square = float((variances**2).sum())
    return float(variances.sum()) ** 2 / square if square >= 1e-12 else 0.0


_SKETCH = "n double, mean array<double>, rows array<double>"


def manifold(df: DataFrame, names: list[str], k: int, rank: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k directions, their variances) of df's columns in one pass: each task folds its rows into a sketch of `rank` rows
    (four times k, by default), and sketches merge by groups until one is left. Memory doesn't follow the rows, and exact
    if rank is the number of columns. Rows with a value that is null or not finite are left out; none give none."""
    rank = min(len(names), rank or 4 * k)

    def row(s: Sketch, group: int):
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([s.n]), pa.array([s.mean.tolist()], pa.list_(pa.float64())), pa.array([s.rows.ravel().tolist()], pa.list_(pa.float64()))], ["group", "n", "mean", "rows"])

    def fold(batches):
        own = Sketch(rank)
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            for at in range(0, len(x), 4096):
                own = own.add(x[at : at + 4096])
        if own.n:
            yield row(own, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        own = Sketch(rank)
        for n, mean, rows in sorted(zip(*(table.column(c).to_pylist() for c in ("n", "mean", "rows")))):
            own = own.merge(Sketch(rank, n, np.array(mean), np.array(rows).reshape(-1, len(names))))
        return pa.Table.from_batches([row(own, table.column("group")[0].as_py())])

    parts = cut(df.select(*(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(fold, f"group long, {_SKETCH}"))
    while (left := parts.count()) > 64:
        parts = cut(parts.withColumn("group", F.col("group") % (left // 16)).groupBy("group").applyInArrow(merge, f"group long, {_SKETCH}"))
    own = Sketch(rank)
    for r in parts.orderBy("n", "mean").collect():  # 64 sketches at most
        own = own.merge(Sketch(rank, r["n"], np.array(r["mean"]), np.array(r["rows"]).reshape(-1, len(names))))
    return (own.mean if own.n else np.zeros(len(names)), *own.directions(k))
