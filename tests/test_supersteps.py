"""Rounds over parts against plain code on the whole."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataform.operators import graph, supersteps


def test_averaging_equals_plain_rounds(spark):
    """Jacobi steps on a ring with chords: each part averages its own cells and what its neighbours sent, until changes are small."""
    n, size = 60, 13
    links = {i: sorted({(i + 1) % n, (i - 1) % n, (i * 7 + 3) % n} - {i}) for i in range(n)}
    for i in range(n):  # what is read is also sent, along the same edges
        for j in links[i]:
            links[j] = sorted({*links[j], i})
    edges = spark.createDataFrame([(i // size, i, j, j // size) for i in range(n) for j in links[i]], "part int, a int, b int, to int")
    state = spark.createDataFrame([(i // size, i, float(i % 11)) for i in range(n)], "part int, cell int, value double")

    def kernel(k, part, fixed, held, inbox, totals):
        own = dict(zip(held.column("cell").to_pylist(), held.column("value").to_pylist()))
        seen = own | dict(zip(inbox.column("cell").to_pylist(), inbox.column("value").to_pylist()))
        a, b, to = (fixed.column(c).to_pylist() for c in ("a", "b", "to"))
        new = own
        if k:  # the first round only sends
            new = {i: sum(seen[y] for x, y in zip(a, b) if x == i) / a.count(i) for i in own}
        sent = {(p, x): new[x] for x, p in zip(a, to) if p != part}
        out = pa.table({"to": pa.array([p for p, _ in sent], pa.int32()), "cell": pa.array([x for _, x in sent], pa.int32()), "value": pa.array(sent.values(), pa.float64())})
        return pa.table({"cell": pa.array(new.keys(), pa.int32()), "value": pa.array(new.values(), pa.float64())}), out, {"change": max(abs(new[i] - own[i]) for i in own) if k else 9.0, "sum": sum(new.values()), "low": min(new.values())}

    got, log = supersteps.supersteps(edges, state, "cell int, value double", kernel, {"change": "max", "sum": "sum", "low": "min"}, 40, lambda t: t["change"] < 0.5)
    x, want = {i: float(i % 11) for i in range(n)}, []
    while not want or want[-1] >= 0.5:
        y = {i: sum(x[j] for j in links[i]) / len(links[i]) for i in x}
        want.append(max(abs(y[i] - x[i]) for i in x))
        x = y
    assert {r["cell"]: round(r["value"], 9) for r in got.collect()} == {i: round(v, 9) for i, v in x.items()}
    assert len(log) == len(want) + 1 and np.allclose([t["change"] for t in log[1:]], want) and abs(log[-1]["sum"] - sum(x.values())) < 1e-9 and abs(log[-1]["low"] - min(x.values())) < 1e-9


def test_traversal_equals_hops(spark):
    rng = random.Random(4)
    for n, extra, width in ((400, 60, 40), (300, 0, 300)):
        edges = [(i, i + 1) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(extra)] + [(5, 5), (n + 1, n + 2)]
        e = spark.createDataFrame(edges, "a bigint, b bigint")
        parts = spark.range(n + 4).select(F.col("id").alias("key"), F.floor(F.col("id") / width).cast("int").alias("part"))
        roots = spark.createDataFrame([(0,), (0,), (n // 2,)], "key bigint")
        got, log = supersteps.traversal(e, parts, roots)
        want = {r["key"]: r["depth"] for r in graph.depths(e, roots, 40).collect()} if extra else {i: i if i < n // 2 else i - n // 2 for i in range(n)}
        found = {r["key"]: r["depth"] for r in got.collect()}
        assert {k: d for k, d in found.items() if d <= 40 or not extra} == want
        assert len(log) < max(found.values()) / 3


def test_small_parts_go_together(spark, monkeypatch):
    e = spark.range(240).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    parts = spark.range(241).select(F.col("id").alias("key"), F.floor(F.col("id") / 6).alias("part"))
    for size, rounds in ((1 << 20, 2), (100, 8)):
        monkeypatch.setattr(supersteps, "TOGETHER", size)
        got, log = supersteps.traversal(e, parts, spark.createDataFrame([(0,)], "key bigint"))
        assert {r["key"]: r["depth"] for r in got.collect()} == {i: i for i in range(241)}
        assert len(log) <= rounds


def test_no_roots_and_parts_without_edges(spark):
    e = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    parts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "key bigint, part string")
    assert supersteps.traversal(e, parts, spark.createDataFrame([], "key bigint"))[0].count() == 0
    assert sorted(map(tuple, supersteps.traversal(e, parts, spark.createDataFrame([(1,), (3,)], "key bigint"))[0].collect())) == [(1, 0), (2, 1), (3, 0)]


def test_diffusion_equals_plain_rounds(spark):
    rng = random.Random(1)
    edges = sorted({(rng.randrange(50), rng.randrange(48)) for _ in range(160)})
    e = spark.createDataFrame(edges, "a bigint, b bigint")
    parts = spark.range(52).select(F.col("id").alias("key"), (F.col("id") % 5).alias("part"))
    values = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 1.5).alias("value"))
    x = {i: i * 1.5 if i < 40 else 0.0 for i in range(52)}
    reads = {i: [b for a, b in edges if a == i] for i in x}
    for give in (None, 0.25):
        y = dict(x)
        for _ in range(3):
            y = {i: 0.5 * y[i] + (sum(y[b] for b in reads[i]) * (give or 1 / len(reads[i]))) if reads[i] else y[i] for i in y}
        got, log = supersteps.diffusion(e, parts, values, 3, 0.5, give)
        found = {r["key"]: r["value"] for r in got.collect()}
        assert found.keys() == y.keys() and all(abs(found[i] - y[i]) < 1e-9 for i in y) and len(log) == 4
    assert len(supersteps.diffusion(e, parts, values, 60, 0.0, None, 100.0)[1]) < 5
