"""Recurrences, streams and iterative fits against plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import federated, learning, maintenance, recurrent, stats, topology, twin
from strataform.streaming import live


class PlainGuard:
    """The rules one after another, with the state in plain fields."""

    def __init__(self, base_dt=1 / 60):
        self.past, self.base, self.dt, self.base_dt, self.off, self.log = [], 1.0, base_dt, base_dt, set(), []

    def take(self, t, energy, parts):
        self.past.append(energy)
        self.past = self.past[-240:]
        if len(self.past) == 1:
            self.base = 1.0 if energy == 0 or math.isnan(energy) else energy
        for i, p in enumerate(parts):
            if not math.isfinite(p):
                self.log.append((t, "nan", i))
                self.past = self.past[: max(0, len(self.past) - 5)]
                self.off.add(i)
                return
        drift = abs(energy - self.base) / max(self.base, 1e-9) * 100
        if drift > 16:
            self.log.append((t, "energy_drift", "critical"))
            self.past = self.past[: max(0, len(self.past) - 8)]
            self.dt = max(self.base_dt / 8, self.dt / 2)
        elif drift > 8:
            self.log.append((t, "energy_drift", "warn"))
            self.dt = max(self.base_dt / 8, self.dt * 0.75)
        elif drift < 3.2 and self.dt < self.base_dt:
            self.dt = min(self.base_dt, self.dt * 1.05)
        mean = sum(parts) / len(parts)
        for i, p in enumerate(parts):
            if i not in self.off and abs(p - mean) / max(mean, 1e-9) > 0.45:
                self.log.append((t, "partition", i))
                self.off.add(i)
        if len(self.past) >= 2 and abs(energy - self.past[-2]) / max(self.dt, 1e-3) * 30 > 950:
            self.log.append((t, "velocity", None))


def energies(seed, n=120):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        parts = [1 + 0.02 * rng.random() + (0.03 * max(0, t - 40) if i == 2 and seed % 2 else 0) for i in range(4)]
        if rng.random() < 0.03:
            parts[rng.randrange(4)] = math.nan
        if 60 < t < 70:
            parts = [p * (1 + 0.05 * (t - 60)) for p in parts]
        if rng.random() < 0.04:
            parts = [p * rng.choice([1.1, 1.3, 4.0]) for p in parts]
        out.append((float(t), float(sum(p for p in parts if math.isfinite(p))), parts))
    return out


def events_of(rows):
    return [(r["t"], r["guard"], r["part"] if r["guard"] in ("nan", "partition") else r["severity"] if r["guard"] == "energy_drift" else None) for r in rows]


def test_guard_equals_a_plain_model(spark):
    series = {k: energies(k) for k in range(6)}
    df = spark.createDataFrame([(k, *x) for k, s in series.items() for x in s], "k int, t double, e double, p array<double>").repartition(5)
    rows = recurrent.guard(df, "k", "t", "e", "p").orderBy("k", "t", "seq").collect()
    kinds = set()
    for k, s in series.items():
        plain = PlainGuard()
        for x in s:
            plain.take(*x)
        assert events_of([r for r in rows if r["k"] == k]) == plain.log
        kinds |= {x[1] for x in plain.log}
    assert kinds == {"nan", "energy_drift", "partition", "velocity"}


def streamed(spark, tmp_path, rows, schema, make, parts=4):
    """Rows in order, a file a batch, through the stream that make() builds."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def same(a, b):
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(a) == key(b.select(*a.columns))


def test_live_guard_equals_the_batch(spark, tmp_path):
    rows = [(k, *x) for x in zip(*(energies(k, 60) for k in range(2))) for k, x in enumerate(x)]
    schema = "k int, t double, e double, p array<double>"
    same(streamed(spark, tmp_path, rows, schema, lambda s: live.live_guard(s, "k", "t", "e", "p")), recurrent.guard(spark.createDataFrame(rows, schema), "k", "t", "e", "p"))


def test_live_risk_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(a, float(t), [rng.gauss(5, 1), 2.0 + 0.01 * t]) for t in range(1, 50) for a in ("u", "v")]
    known = {"failures": {"u": [[9.0, 3.0]]}, "optimal": {"v": [[5.0, 2.0]]}, "trajectories": {"u": [[[9.0, 3.0]] * 4]}, "window": 4}
    schema = "a string, t double, v array<double>"
    same(streamed(spark, tmp_path, rows, schema, lambda s: live.live_risk(s, "a", "t", "v", **known)), maintenance.risk_series(spark.createDataFrame(rows, schema), "a", "t", "v", **known))


def test_live_fusion_and_changes(spark, tmp_path):
    rows = [(k, float(t), math.sin(t / 5 + k)) for t in range(40) for k in range(2)]
    schema = "k int, t double, v double"
    same(streamed(spark, tmp_path / "a", rows, schema, lambda s: live.live_fusion(s, "k", "t", "v")), recurrent.alpha_beta(spark.createDataFrame(rows, schema), "k", "t", "v"))
    jobs = [("j", 1, "queued", 0), ("j", 2, "running", 0), ("j", 3, "running", 0), ("j", 4, "running", 50), ("j", 5, "done", 100), ("k", 6, "queued", 0)]
    got = streamed(spark, tmp_path / "b", jobs, "id string, n int, status string, progress int", lambda s: live.live_changes(s, "id", "n", ["status", "progress"]))
    assert sorted((r["id"], r["n"], tuple(r["changed"])) for r in got.collect()) == [("j", 1, ("status", "progress")), ("j", 2, ("status",)), ("j", 4, ("progress",)), ("j", 5, ("status", "progress")), ("k", 6, ("status", "progress"))]


def test_live_pairs_come_once(spark, tmp_path):
    pairs = [(0, 1), (2, 3), (1, 0), (1, 1), (0, 99), (-1, 2), (3, 2), (4, 2)]
    got = streamed(spark, tmp_path, pairs, "i int, j int", lambda s: live.live_pairs(s, "i", "j", 5))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (2, 3), (2, 4)]


CASES = (
    ([(1, 1.0), (2, 6.0)], {}, [("fired", 2)]),
    ([(1, 9.0), (2, 9.0), (3, 9.0)], {"consecutive": 3}, [("fired", 3)]),
    ([(1, 6.0), (2, 9.0), (3, 7.0)], {}, [("fired", 1)]),
    ([(1, 6.0), (2, 4.5), (3, 3.0)], {"margin": 0.2}, [("fired", 1), ("cleared", 3)]),
    ([(1, 99.0)], {"enabled": False}, []),
    ([(1, None), (2, math.nan)], {}, []),
    ([(1, 9.0), (2, None), (3, 9.0)], {"consecutive": 2}, [("fired", 3)]),
)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_rules_of_alerts(spark, case):
    series, change, want = CASES[case]
    rule = {"id": "r", "metric": "drift", "op": ">", "threshold": 5.0, "margin": 0.1} | change
    df = spark.createDataFrame([("a", float(t), v) for t, v in series], "k string, t double, drift double")
    got = recurrent.alert_log(df, "k", "t", [rule]).orderBy("t").collect()
    assert [(r["event"], r["t"]) for r in got] == want
    if case == 3:
        assert (got[1]["peak"], got[1]["n"], got[1]["first_t"]) == (6.0, 1, 1.0)


def test_components_equal_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 4)) + [1, 2, 3, 4]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    mean, dev, components, shares = stats.pca(df, list("abcd"), 2)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(shares, values[::-1][:2] / values.sum())
    assert all(np.isclose(abs(c @ vectors[:, -1 - i]), 1) for i, c in enumerate(components))
    latent = np.array([r["latent"] for r in stats.project(df, list("abcd"), mean, dev, components).orderBy("id").collect()])
    assert np.allclose(latent, z @ components.T)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    start = stats.spread_centres(df, ["a", "b"], "id", 3, seed=4)
    assert start == stats.spread_centres(df, ["a", "b"], "id", 3, seed=4) and all(any(np.allclose(s, r) for r in x) for s in start)
    c = np.array(start)
    for _ in range(20):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
    centres, out = stats.kmeans(df, ["a", "b"], start)
    assert np.allclose(centres, c) and [r["cluster"] for r in out.orderBy("id").collect()] == near.tolist()
    same_place = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "id int, a double, b double")
    assert len(stats.spread_centres(same_place, ["a", "b"], "id", 3)) == 1


def test_federated_rounds_by_hand(spark):
    rng = np.random.default_rng(0)
    data = {k: (rng.standard_normal((30 + k, 2)), None) for k in range(3)}
    rows = []
    for k, (x, _) in data.items():
        y = x @ [1.0, -2.0] + 0.5
        data[k] = (np.column_stack((x, np.ones(len(x)))), y)
        rows += [(k, *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    w = np.zeros(3)
    for _ in range(3):
        deltas = []
        for x, y in data.values():
            v = w.copy()
            for _ in range(4):
                v -= 0.1 * x.T @ (x @ v - y) / len(x)
            delta = v - w
            deltas.append(delta * min(1, 0.5 / np.linalg.norm(delta)))
        w = w + np.mean(deltas, axis=0)
    out = federated.federated(df, "k", ["a", "b"], "y", rounds=3, epochs=4, rate=0.1, clip=0.5).orderBy("round").collect()
    assert np.allclose(out[-1]["weights"], w) and out[-1]["loss"] < out[0]["loss"] and out[-1]["epsilon_spent"] == 1.5
    sums = federated.client_sums(df, "k", ["a", "b"], "y")
    noisy = federated.local_updates(sums, [0.0] * 3, noise=0.1, seed=1).collect()
    assert noisy == federated.local_updates(sums, [0.0] * 3, noise=0.1, seed=1).collect() != federated.local_updates(sums, [0.0] * 3, noise=0.1, seed=2).collect()


def test_training_learns(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 2))
    rows = [(i, float(a), float(b), float(0.7 * a - 0.2 * b + 0.1), float(a + b > 1)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, q double, f double")
    quality, defect = learning.train(df, ["a", "b"], "q", "f", epochs=60, rate=0.5)
    got = learning.evaluate(learning.predict(df, ["a", "b"], quality, defect), "q", "f").first()
    assert got["mse"] < 1e-3 and got["accuracy"] > 0.9


def test_walls_cavities_and_parts(spark):
    n = 7  # a square ring: a hole in the middle that the outside doesn't reach
    cells = {(i, j) for i in range(n) for j in range(n)}
    ids = {c: c[0] * n + c[1] for c in cells}
    wall = {c for c in cells if max(abs(c[0] - 3), abs(c[1] - 3)) == 2}
    open_ = cells - wall
    link = [(ids[a], ids[b]) for a in open_ for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)) if b in open_]
    nodes = spark.createDataFrame([(ids[c],) for c in open_], "key bigint")
    outside = spark.createDataFrame([(ids[c],) for c in open_ if 0 in c or n - 1 in c], "key bigint")
    inner = {ids[c] for c in cells if max(abs(c[0] - 3), abs(c[1] - 3)) < 2}
    got = topology.cavities(nodes, spark.createDataFrame(link, "a bigint, b bigint"), outside).collect()
    assert {r["key"] for r in got} == inner and {r["component"] for r in got} == {min(inner)}
    chain = [(i, i + 1) for i in range(8)]
    edges = spark.createDataFrame([*chain, *((b, a) for a, b in chain)], "a bigint, b bigint")
    thick = topology.wall_thickness(edges, spark.createDataFrame([(0,), (3,), (8,)], "key bigint"), 4)
    assert sorted(map(tuple, thick.collect())) == [(0, 3), (3, 3), (8, 0)]


def test_balance_recovery_and_rounds(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(39)], "a bigint, b bigint")
    owners = spark.createDataFrame([(i, 0 if i < 30 else 1) for i in range(40)], "key bigint, owner int")
    after, moves = topology.migration(line, owners, rounds=20)
    sizes = {r["owner"]: r["count"] for r in after.groupBy("owner").count().collect()}
    assert sum(sizes.values()) == 40 and sizes[0] <= 30 and moves.count() == 30 - sizes[0] > 0
    parts = spark.createDataFrame([(i, i % 3, 10 - i) for i in range(9)], "part int, owner int, size int")
    plan = topology.recovery(parts, spark.createDataFrame([(0,)], "owner int"), spark.createDataFrame([(1,), (2,)], "owner int")).collect()
    assert {r["part"] for r in plan} == {0, 3, 6} and {r["to_owner"] for r in plan} == {1, 2}
    a, root = topology.digests(parts, "owner", ["part", "size"])
    b, again = topology.digests(parts.orderBy(F.desc("part")), "owner", ["part", "size"])
    assert root.first() == again.first() and a.count() == 3
    out = topology.send_rounds(spark.createDataFrame([(0, 1, 5), (0, 2, 5), (1, 2, 5), (3, 4, 5)], "a int, b int, n int")).collect()
    assert sorted((r["a"], r["b"], r["round"]) for r in out) == [(0, 1, 0), (0, 2, 1), (1, 2, 2), (3, 4, 0)]


def plain_twin(frames, dims, warm_up):
    """All frames so far are gone through again for each value, by numpy's own statistics."""
    raws, stds, past, basis, age, drift, out = [], [], [], None, 0, 0.0, []
    for n, (x, far) in enumerate(frames, 1):
        raws.append(np.array(x))
        dev = np.std(raws, axis=0, ddof=1) if n > 1 else np.ones(len(x))
        stds.append((raws[-1] - np.mean(raws, axis=0)) / np.maximum(1e-6, dev))
        if n >= warm_up and (basis is None or age >= 8):
            w = np.array(stds[-64:])
            values, vectors = np.linalg.eigh(np.cov(w.T, bias=True))
            rows = vectors[:, np.argsort(-values, kind="stable")[:dims]].T
            basis, age = np.array([r * (-1 if r[np.abs(r).argmax()] < 0 else 1) for r in rows]), 0
        else:
            age += 1
        latent = basis @ stds[-1] if basis is not None else np.zeros(min(dims, len(x)))
        drift = 0.85 * drift + 0.15 * (abs(far - past[-1][1]) if past else 0)
        radius = 0.5
        if len(past) >= 8:
            jumps = sorted(np.linalg.norm(past[i][0] - past[i - 1][0]) for i in range(max(1, len(past) - 32), len(past)))
            radius = jumps[int(len(jumps) * 0.9)] or 0.5
        odd = min(1.0, min(np.linalg.norm(latent - p) for p, _ in past[-64:]) / (2 * max(0.2, radius))) if len(past) >= 8 else 0.0
        out.append((drift / max(1e-6, far * 0.05 + 0.1), odd, *latent))
        past.append((latent, far))
    return np.array(out)


def test_twins_equal_a_plain_model_and_the_stream(spark, tmp_path):
    rng = np.random.default_rng(7)
    frames = [([float(v) for v in rng.normal(0, 1, 3) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.5]])], float(abs(rng.normal(1, 0.3)))) for _ in range(90)]
    schema = "k string, t double, raw array<double>, far double"
    rows = [("a", float(t), *f) for t, f in enumerate(frames)]
    got = twin.twin_states(spark.createDataFrame(rows, schema), "k", "t", "raw", "far", dims=2, warm_up=10)
    have = np.array([[r["drift_sigma"], r["anomaly"], *r["latent"]] for r in got.orderBy("t").collect()])
    assert np.allclose(have, plain_twin(frames, 2, 10), atol=1e-8)
    live_ = streamed(spark, tmp_path, rows[:40], schema, lambda s: live.live_twins(s, "k", "t", "raw", "far", dims=2, warm_up=10))
    same(live_, got.filter("t < 40"))
