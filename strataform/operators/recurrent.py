"""Recurrences over each key's samples in order: filters, adaptive thresholds and guards."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from strataform.operators.stats import Sketch, effective_dimension


class Steps(NamedTuple):
    """A recurrence: the first state, step(state, order, values...) to the next state and the rows that a sample makes, and their columns. Batches fold it, streams follow it (streaming.live)."""

    start: Callable
    step: Callable
    outputs: str


def fold(df: DataFrame, key: str, order: str, values: list[str], steps: Steps) -> DataFrame:
    """(key, order, outputs) of a recurrence over each key's rows in order.

    Rows are dealt by key and sorted by key and order (then values) within each partition, so a task streams through
    its keys one Arrow batch after another and holds one state; a key's series may be of any length.
    """
    start, step, outputs = steps
    out_kind = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {outputs}"
    own = df.select(key, order, *values).repartition(key).sortWithinPartitions(key, order, *values)
    schema = to_arrow_schema(df.select(key, order).limit(0).selectExpr("*", *(f"cast(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ", 1) for x in outputs.split(", ")))).schema)

    def run(batches):
        last, state = (), None
        for batch in batches:
            rows = []
            for k, t, *v in zip(*(c.to_pylist() for c in batch.columns)):
                if (k,) != last:
                    last, state = (k,), start()
                state, made = step(state, t, *v)
                rows += [(k, t, *m) for m in made]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return own.mapInArrow(run, out_kind)


def alpha_beta_steps(gain: float = 0.35, tick: float = 0.05) -> Steps:
    """Of (value, truth): predict, fused, residual, speed, mae and rmse. Predict by the speed over a fixed tick, correct by a share of the residual; the speed is what that moved by. mae and rmse: running errors against the truth, the sample itself if none is given. Samples that are null change nothing."""

    def step(state, _, v, exact):
        level, speed, n, mae, rmse = state
        if v is None:
            return state, []
        ahead = level + speed * tick
        off = v - ahead
        now = ahead + gain * off
        speed = (now - level) / max(tick, 1e-3)
        err = abs(now - (v if exact is None else exact))
        n += 1
        mae += (err - mae) / n
        rmse = math.sqrt(rmse * rmse + (err * err - rmse * rmse) / n)
        return (now, speed, n, mae, rmse), [(ahead, now, off, speed, mae, rmse)]

    return Steps(lambda: (0.0, 0.0, 0, 0.0, 0.0), step, "predict double, fused double, residual double, speed double, mae double, rmse double")


def alpha_beta(df: DataFrame, key: str, t: str, value: str, truth: str | None = None, **steps) -> DataFrame:
    """(key, t, predict, fused, residual, speed, mae, rmse) of alpha_beta_steps()."""
    own = df.select(key, t, df[value].cast("double").alias("_v"), df[truth or value].cast("double").alias("_exact"))
    return fold(own, key, t, ["_v", "_exact"], alpha_beta_steps(**steps))


def ewma_step(state: tuple | None, score: float, alpha: float) -> tuple[float, float]:
    """The next (mean, variance) of a score's size; the first one sets the mean, and half of itself (1e-6 at least) as variance."""
    s = abs(score)
    if state is None:
        return s, max(1e-6, s * 0.5)
    off = s - state[0]
    return state[0] + alpha * off, (1 - alpha) * (state[1] + alpha * off * off)


def threshold_steps(alpha: float = 0.05, k: float = 3.0) -> Steps:
    """Of a score: ewma, variance and threshold, k deviations above the smoothed size of the scores so far. Null scores change nothing."""

    def step(state, _, v):
        if v is None:
            return state, []
        state = ewma_step(state, v, alpha)
        return state, [(*state, state[0] + k * math.sqrt(state[1]))]

    return Steps(lambda: None, step, "ewma double, variance double, threshold double")


def adaptive_threshold(df: DataFrame, key: str, t: str, value: str, **steps) -> DataFrame:
    """(key, t, ewma, variance, threshold) of threshold_steps()."""
    return fold(df, key, t, [value], threshold_steps(**steps))


COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}
#: Limits of energy drift in percent, constraint error, speed, and a part's share of deviation.
LIMITS = {"drift": 8.0, "constraint": 0.04, "speed": 950.0, "part": 0.45}
#: Energies that a guard remembers.
REMEMBERED = 240


def guard_steps(base_dt: float = 1 / 60, limits: dict | None = None) -> Steps:
    """Of (energy, parts): seq, guard, severity, value, threshold, part, mitigation and dt of what a watchdog reports, in order.

    parts: an array of the parts' energies, energy: their sum. The first energy is the baseline (1 for 0 and for what isn't a number). A part that
    isn't finite takes back five samples and is isolated; nothing else is checked then. A drift beyond the limit
    shrinks the step to three quarters, twice the limit takes back eight samples and halves it, down to an eighth;
    under two fifths of the limit it recovers by a twentieth. A part far from the mean is isolated, once. The
    constraint error follows the step, the speed the change of energy. A history that is taken back whole sets a new
    baseline with the next sample. A null energy is one that isn't a number: nothing drifts.
    """
    lim = LIMITS | (limits or {})

    def step(state, now, e, ps):
        past, base, dt, isolated = state
        out = []
        e, ps = math.nan if e is None else e, [math.nan if p is None else p for p in ps or []]

        def report(name, severity, value, threshold, part, mitigation):
            out.append((len(out), name, severity, value, threshold, part, mitigation, dt))

        past = [*past, e][-REMEMBERED:]
        if len(past) == 1:
            base = 1.0 if e == 0 or math.isnan(e) else e
        broken = next((i for i, p in enumerate(ps) if not math.isfinite(p)), None)
        if broken is not None:
            report("nan", "critical", None, 0.0, broken, "rollback")
            return (past[: max(0, len(past) - 5)], base, dt, isolated | {broken}), out
        drift = abs(e - base) / max(base, 1e-9) * 100
        if drift > lim["drift"]:
            critical = drift > lim["drift"] * 2
            report("energy_drift", "critical" if critical else "warn", drift, lim["drift"], None, "rollback" if critical else "shrink_dt")
            if critical:
                past = past[: max(0, len(past) - 8)]
            dt = max(base_dt / 8, dt * (0.5 if critical else 0.75))
        elif drift < lim["drift"] * 0.4 and dt < base_dt:
            dt = min(base_dt, dt * 1.05)
        mean = sum(ps) / len(ps) if ps else 0.0
        for i, p in enumerate(ps):
            if i not in isolated and (off := abs(p - mean) / max(mean, 1e-9)) > lim["part"]:
                report("partition", "warn", off, lim["part"], i, "isolate_partition")
                isolated = isolated | {i}
        error = max(0.0, dt / base_dt - 1) * 0.05 + 0.005 * abs(math.sin(now * 4))
        if error > lim["constraint"]:
            report("constraint", "warn", error, lim["constraint"], None, "shrink_dt")
        if len(past) >= 2 and (speed := abs(e - past[-2]) / max(dt, 1e-3) * 30) > lim["speed"]:
            report("velocity", "warn", speed, lim["speed"], None, "clamp_velocity")
        return (past, base, dt, isolated), out

    return Steps(lambda: ([], 1.0, base_dt, frozenset()), step, "seq int, guard string, severity string, value double, threshold double, part int, mitigation string, dt double")


def guard(df: DataFrame, key: str, t: str, energy: str, parts: str, **steps) -> DataFrame:
    """(key, t, seq, guard, severity, value, threshold, part, mitigation, dt) of guard_steps()."""
    return fold(df, key, t, [energy, parts], guard_steps(**steps))


def clears(v: float, op: str, threshold: float, margin: float) -> bool:
    if op[0] == ">":
        return v < threshold * (1 - margin)
    return v > threshold * (1 + margin) if op[0] == "<" else v != threshold


def alert_steps(rules: list[dict], metrics: list[str]) -> Steps:
    """Of the metrics: rule_id, severity, event, value, first_t, peak and n when a rule fires ("fired") and when its alert closes ("cleared").

    A rule has id, metric, op and threshold, and may have consecutive (1), margin (0), severity ("warn") and enabled
    (true). Values that are null or not finite change nothing.
    """
    live = [r for r in rules if r.get("enabled", True) is not False]

    def step(state, now, *values):
        sample, out, state = dict(zip(metrics, values)), [], dict(state)
        for r in live:
            v = sample.get(r["metric"])
            if v is None or not math.isfinite(v):
                continue
            run, open_ = state.get(r["id"], (0, None))
            op, limit = r["op"], r["threshold"]
            if COMPARE[op](v, limit):
                run += 1
                if run >= r.get("consecutive", 1):
                    if open_ is None:
                        open_ = (now, v, 1)
                        out.append((r["id"], r.get("severity", "warn"), "fired", v, now, v, 1))
                    else:
                        worst = max if op[0] == ">" else min if op[0] == "<" else lambda a, _: a
                        open_ = (open_[0], worst(open_[1], v), open_[2] + 1)
            else:
                run = 0
                if open_ is not None and clears(v, op, limit, r.get("margin", 0.0)):
                    out.append((r["id"], r.get("severity", "warn"), "cleared", v, *open_))
                    open_ = None
            state[r["id"]] = (run, open_)
        return state, out

    return Steps(dict, step, "rule_id string, severity string, event string, value double, first_t double, peak double, n bigint")


def alert_log(df: DataFrame, key: str, t: str, rules: list[dict]) -> DataFrame:
    """(key, t, rule_id, severity, event, value, first_t, peak, n) of alert_steps(): every rule over its metric's column."""
    metrics = sorted({r["metric"] for r in rules})
    own = df.select(df[key], df[t].cast("double").alias(t), *(df[m].cast("double").alias(m) for m in metrics))
    return fold(own, key, t, metrics, alert_steps(rules, metrics))


def change_steps(columns: list[str]) -> Steps:
    """Of the columns: `changed`, the names of those that differ from the sample before (all for the first); nothing where none does."""

    def step(state, _, *values):
        changed = [c for c, v, w in zip(columns, values, state or values) if state is None or v != w]
        return values, [(changed,)] if changed else []

    return Steps(lambda: None, step, "changed array<string>")


def manifold_steps(k: int, rank: int) -> Steps:
    """Of a vector: latent (its place on the k strongest directions of all so far, itself included), residual (its distance from them) and dimension (how many directions carry the variance). Vectors that are null, or hold a value that is null or not finite, change nothing."""

    def step(state, _, vector):
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            return state, []
        x = np.array(vector, float)
        state = state.add(x[None, :])
        directions, variances = state.directions(k)
        off = x - state.mean
        latent = directions @ off
        return state, [(latent.tolist(), float(np.linalg.norm(off - latent @ directions)), effective_dimension(variances))]

    return Steps(lambda: Sketch(rank), step, "latent array<double>, residual double, dimension double")


def manifold_series(df: DataFrame, key: str, t: str, vector: str, k: int = 2, rank: int = 8) -> DataFrame:
    """(key, t, latent, residual, dimension) of manifold_steps()."""
    return fold(df, key, t, [vector], manifold_steps(k, rank))
