"""Telemetry as streams: validation with a quarantine, recurrences whose state is kept for each key, pairs told once, windowed counts."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from strataform.operators import maintenance, recurrent
from strataform.operators.recurrent import Steps
from strataform.operators.twin import twin_steps
from strataform.sources.readers import valid_sample


def split_valid(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows, batch or stream."""
    ok = F.coalesce(valid_sample(), F.lit(False))
    return samples.filter(ok), samples.filter(~ok)


def follow(samples: DataFrame, key: str, order: str, values: list[str], steps: Steps) -> DataFrame:
    """(key, order, outputs) of a recurrence over a stream, as recurrent.fold gives them over a table.

    Samples of a key come in order within and across batches. State is that of the recurrence, one a key, whatever has
    gone by. Batches reach Python as pandas frames, in which null and NaN are the same: both count as null.
    """
    names = [x.split()[0] for x in steps.outputs.split(", ")]

    def run(k, frames, state):
        now = pickle.loads(state.get[0]) if state.exists else steps.start()
        out = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable")[[order, *values]].itertuples(index=False):
            clean = [v.tolist() if isinstance(v, np.ndarray) else None if not hasattr(v, "__len__") and pd.isna(v) else v for v in row]
            now, made = steps.step(now, *clean)
            out += [(k[0], row[0], *m) for m in made]
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=[key, order, *names], dtype=object)  # else a null turns whole numbers into floats

    kind = {c: samples.schema[c].dataType.simpleString() for c in (key, order)}
    return samples.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}, {steps.outputs}", "state binary", "append", GroupStateTimeout.NoTimeout)


def live_alerts(samples: DataFrame, key: str, t: str, rules: list[dict]) -> DataFrame:
    """Every rule's alerts as they fire and as they close: recurrent.alert_log over a stream."""
    metrics = sorted({r["metric"] for r in rules})
    return follow(samples, key, t, metrics, recurrent.alert_steps(rules, metrics))


def live_guard(samples: DataFrame, key: str, t: str, energy: str, parts: str, **steps) -> DataFrame:
    """recurrent.guard over a stream."""
    return follow(samples, key, t, [energy, parts], recurrent.guard_steps(**steps))


def live_risk(samples: DataFrame, asset: str, t: str, vector: str, **steps) -> DataFrame:
    """maintenance.risk_series over a stream: each asset's score as its readings come."""
    own = samples.withColumn("_name", F.col(asset))
    return follow(own, asset, t, ["_name", vector], maintenance.risk_steps(**steps)).withColumn("priority", maintenance.priority(F.col("risk")))


def live_manifold(samples: DataFrame, key: str, t: str, vector: str, k: int = 2, rank: int = 8) -> DataFrame:
    """recurrent.manifold_series over a stream: the sketch of all that a key has sent is its state."""
    return follow(samples, key, t, [vector], recurrent.manifold_steps(k, rank))


def live_fusion(samples: DataFrame, key: str, t: str, value: str, truth: str | None = None, **steps) -> DataFrame:
    """recurrent.alpha_beta over a stream."""
    own = samples.select(key, t, F.col(value).cast("double").alias("_v"), F.col(truth or value).cast("double").alias("_exact"))
    return follow(own, key, t, ["_v", "_exact"], recurrent.alpha_beta_steps(**steps))


def live_changes(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, order, changed): which of the columns a key's row changes; rows that change none are left out."""
    return follow(rows, key, order, columns, recurrent.change_steps(columns))


def live_pairs(pairs: DataFrame, i: str, j: str, n: Column | int, observed: str = "pairs") -> DataFrame:
    """(lo, hi) of every valid pair the first time that it comes: both within 0..n - 1, not the same. Metrics of each batch, under the name given: how many rows came and how many were invalid; a pair that has come is state."""
    c, d = F.col(i), F.col(j)
    ok = F.coalesce((c != d) & (c >= 0) & (d >= 0) & (c < n) & (d < n), F.lit(False))
    own = pairs.withColumn("_ok", ok).observe(observed, F.count(F.lit(1)).alias("input"), F.count_if(~F.col("_ok")).alias("invalid"))
    return own.filter("_ok").select(F.least(c, d).alias("lo"), F.greatest(c, d).alias("hi")).dropDuplicates(["lo", "hi"])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) over tumbling windows with a watermark; an addition of this library."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def live_twins(frames: DataFrame, twin: str, t: str, raw: str, far: str, **steps) -> DataFrame:
    """twin.twin_states over a stream."""
    return follow(frames, twin, t, [raw, far], twin_steps(**steps))
