"""Fabrication classes, partitions and sketches against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import decision, recurrent, stats, topology
from strataform.streaming import live
from tests.test_recurrent import streamed


def plain_fabrication(cells, links):
    around = {i: set() for i, *_ in cells}
    for a, b in links:
        if a != b:
            around[a].add(b), around[b].add(a)
    z, edge = {i: h for i, h, _ in cells}, {i: bool(b) for i, _, b in cells}
    kind = {i: ("boundary" if any(z[j] < z[i] - 1e-9 for j in around[i]) else "overhang") if edge[i] else "interior" for i in z}
    far, front = {i: 0 for i in z if edge[i]}, [i for i in z if edge[i]]
    while front:
        front = [j for i in front for j in around[i] if j not in far and not far.update({j: far[i] + 1})]
    seen, pocket = set(), {}
    for s in sorted(z):
        if edge[s] or s in seen:
            continue
        group, todo = {s}, [s]
        while todo:
            for j in around[todo.pop()]:
                if not edge[j] and j not in group:
                    group.add(j), todo.append(j)
        seen |= group
        if not any(edge[j] for i in group for j in around[i]):
            pocket |= {i: min(group) for i in group}
    for i in z:
        if i in pocket:
            kind[i] = "trapped"
        elif not edge[i] and far.get(i, 99) > 3:
            kind[i] = "deep"
    return {i: (kind[i], kind[i] == "boundary" and sum(edge[j] for j in around[i]) >= 4, pocket.get(i)) for i in z}


@pytest.mark.parametrize("seed", [1, 2])
def test_fabrication_equals_plain_code(spark, seed):
    rng = random.Random(seed)
    n = 260
    cells = [(i, rng.choice([0.0, 1.0, 1.0 + 1e-12, 2.0]), rng.choice([True, False, False, False]) if i < 200 else None) for i in range(n)]
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3), (4, 5), (5, 4)]
    got = topology.fabrication(spark.createDataFrame(cells, "id int, z double, boundary boolean"), spark.createDataFrame(links, "a int, b int"))
    found = {r["id"]: (r["class"], r["dense"], r["pocket"]) for r in got.collect()}
    want = plain_fabrication(cells, links)
    assert found == want and len({x[0] for x in want.values()}) >= 4
    assert topology.fabrication(spark.createDataFrame([], "id int, z double, boundary boolean"), spark.createDataFrame([], "a int, b int")).count() == 0


def cut_of(edges, owner):
    return sum(owner[a] != owner[b] for a, b in edges)


def test_partitions_cut_less_than_strips(spark):
    """Two dense clouds joined by a few edges, and a grid whose strips start from shuffled numbers."""
    rng = random.Random(5)
    clouds = [(rng.randrange(60) * 2 + s, rng.randrange(60) * 2 + s) for s in (0, 1) for _ in range(500)] + [(2 * k, 2 * k + 1) for k in range(3)]
    e = spark.createDataFrame(clouds, "a int, b int")
    got = {r["key"]: r["owner"] for r in topology.spectral_partition(e, 2, rounds=16).collect()}
    sizes = sorted(map(list(got.values()).count, (0, 1)))
    assert len(got) == 120 and sizes[0] >= 57 and cut_of(clouds, got) == 3
    w = 16
    grid = [(i, j) for i in range(w * w) for j in ((i + 1) if i % w < w - 1 else i, i + w) if i != j and j < w * w]
    e = spark.createDataFrame(grid, "a int, b int")
    noisy = spark.createDataFrame([(i, (i // w) // 4 if rng.random() < 0.8 else rng.randrange(4)) for i in range(w * w)], "key int, owner int")
    before = {r["key"]: r["owner"] for r in noisy.collect()}
    after = {r["key"]: r["owner"] for r in topology.refined(e, noisy, 12, 1.15).collect()}
    assert cut_of(grid, after) < cut_of(grid, before) * 0.6 and after.keys() == before.keys()
    assert all(0.8 * w * w / 4 <= list(after.values()).count(k) <= 1.2 * w * w / 4 for k in range(4))


def test_second_vector_is_near_the_eigenvector(spark):
    n = 12
    edges = [(i, i + 1) for i in range(n - 1)]
    got = {r["key"]: r["value"] for r in topology.second_vector(spark.createDataFrame(edges, "a int, b int"), 48).collect()}
    walk = np.zeros((n, n))
    for a, b in edges:
        walk[a, b] = walk[b, a] = 1
    degree = walk.sum(axis=1)
    values, vectors = np.linalg.eigh(walk / np.sqrt(np.outer(degree, degree)))
    want = vectors[:, np.argsort(values)[-2]] / np.sqrt(degree)
    x = np.array([got[i] for i in range(n)])
    assert abs(np.corrcoef(x, want)[0, 1]) > 0.95


def angle(a, b):
    """The largest angle between the spaces that rows span, in degrees."""
    qa, qb = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    return math.degrees(math.acos(min(1, np.linalg.svd(qa.T @ qb)[1].min())))


def test_sketches_find_the_directions(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3)) @ (rng.normal(size=(3, 12)) * [[9.0], [5.0], [3.0]]) + rng.normal(size=(3000, 12)) * 0.3 + 7
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)).repartition(7)
    odd = df.unionByName(df.limit(2).withColumn("c3", F.lit(None).cast("double"))).unionByName(df.limit(2).withColumn("c4", F.lit(float("nan"))))
    _, _, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    mean, directions, variances = stats.manifold(odd, names, 3)
    assert np.allclose(mean, x.mean(axis=0)) and angle(directions, right[:3]) < 0.5
    assert np.allclose(variances, np.linalg.svd(x - x.mean(axis=0))[1][:3] ** 2 / 2999, rtol=0.01)
    assert angle(stats.manifold(df, names, 3, rank=3)[1], right[:3]) < 5
    assert 1 <= stats.effective_dimension(variances) <= 3 and len(stats.manifold(df.limit(0), names, 3)[1]) == 0
    rows = [(k, float(t), v.tolist() if t % 9 else None) for t, v in enumerate(x[:60]) for k in ("a", "b")]
    schema = "k string, t double, v array<double>"
    batch = recurrent.manifold_series(spark.createDataFrame(rows, schema), "k", "t", "v", 2, 12)
    stream = streamed(spark, tmp_path, rows, schema, lambda s: live.live_manifold(s, "k", "t", "v", 2, 12))
    shape = lambda df: sorted((r["k"], r["t"], [round(z, 6) for z in r["latent"]], round(r["residual"], 6), round(r["dimension"], 6)) for r in df.collect())
    assert shape(batch) == shape(stream)
    own = np.array([v for t, v in enumerate(x[:60]) if t % 9])
    _, _, right = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
    last = max((r for r in batch.collect() if r["k"] == "a"), key=lambda r: r["t"])
    assert np.allclose(np.abs(last["latent"]), np.abs(right[:2] @ (own[-1] - own.mean(axis=0))), rtol=1e-4)


def test_first_energies_that_are_no_numbers(spark, tmp_path):
    """A baseline that isn't a number is 1, so what follows drifts, in a table and in a stream."""
    rows = [(k, t, e, [1.0, 1.0]) for k, first in ((1, None), (2, math.nan), (3, 0.0)) for t, e in ((0.0, first), (1.0, 100.0), (2.0, 1000.0))]
    schema = "k int, t double, e double, p array<double>"
    batch = recurrent.guard(spark.createDataFrame(rows, schema), "k", "t", "e", "p")
    stream = streamed(spark, tmp_path, rows, schema, lambda s: live.live_guard(s, "k", "t", "e", "p"), parts=3)
    for got in (batch, stream):
        drifts = sorted((r["k"], r["t"], r["severity"], r["value"]) for r in got.collect() if r["guard"] == "energy_drift" and r["t"] > 0)
        assert drifts == [(1, 1.0, "critical", 9900.0), (2, 1.0, "critical", 9900.0), (3, 2.0, "critical", 900.0)]  # a history that is taken back whole begins anew


@pytest.mark.parametrize(("objectives", "n"), [("ab", 400), ("abc", 60)])
def test_fronts_equal_plain_peeling(spark, monkeypatch, objectives, n):
    monkeypatch.setattr(decision, "SWEEP", 90)
    rng = random.Random(len(objectives))
    rows = [(i, *(float(rng.randrange(25)) for _ in range(3))) for i in range(n)] + [(n, None, 1.0, 1.0), (n + 1, 1.0, float("nan"), 1.0)]
    pts = {i: x[: len(objectives)] for i, *x in rows[:n]}
    left, want, k = dict(pts), {}, 0
    while left:
        first = [i for i, x in left.items() if not any(y != x and all(a <= b for a, b in zip(y, x)) for y in left.values())]
        want |= dict.fromkeys(first, k)
        left = {i: x for i, x in left.items() if i not in want}
        k += 1
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    assert {r["id"]: r["front"] for r in decision.front_ranks(df, "id", list(objectives)).collect()} == want
    assert {r["id"]: r["front"] for r in decision.front_ranks(df, "id", list(objectives), 2).collect()} == {i: f if f < 2 else -1 for i, f in want.items()}
    assert decision.front_ranks(df.limit(0), "id", list(objectives)).count() == 0
