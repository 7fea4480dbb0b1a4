"""Nearest neighbours against brute force."""

import numpy as np

from strataform.llm import ann


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], "t") for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, list string")


def brute(x, q, k):
    x = np.float32(x).astype(float)
    out = {}
    for i in q:
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:k]
        out[i] = order
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((10, 24))
    x = centre[rng.integers(0, 10, 3000)] + 0.7 * rng.standard_normal((3000, 24))
    x[100:400] = x[100]  # one vector that is very common
    got = {}
    for r in ann.nearest(table(spark, x), lambda i: i % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(x, range(0, 3000, 20), 20)
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[i]} & set(want[i])) for i in want)
    assert hit >= 0.9 * 20 * len(want)
    y = np.float32(x).astype(float)
    for i, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 21))
        assert np.allclose([s for *_, s in rows], [(y[i] * y[v]).sum() for _, v, _ in rows], rtol=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))


def test_odd_rows(spark):
    x = [[1, 0], [0.5, 0.5], [0, 0], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 0], [1, 2, 3]]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table(spark, x), lambda i: i >= 0, lists=1).collect())
    assert got == [(0, 1, 7), (0, 2, 1), (1, 1, 0), (1, 2, 7), (7, 1, 0), (7, 2, 1)]
    assert ann.nearest(table(spark, []), lambda i: i >= 0).count() == 0


def test_lengths_are_searched_apart_and_ids_may_be_strings(spark):
    rng = np.random.default_rng(3)
    x = [list(rng.standard_normal(5 if i % 3 else 8)) for i in range(90)]
    rows = [(f"v{i:02}", [float(c) for c in v]) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), lambda i: i.isin("v03", "v04"), k=4, lists=1).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (3, 4):
        same = [i for i in range(90) if len(x[i]) == len(x[q]) and i != q]
        assert got[f"v{q:02}"] == [f"v{i:02}" for i in sorted(same, key=lambda i: -np.dot(x[i], x[q]))[:4]]


def test_ties_between_tiles_go_to_the_smaller_id(spark):
    x = [[1.0, 0.0]] * 5000 + [[0.5, 0.1]] * 10
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table(spark, x), lambda i: i.isin(0, 4999), k=3).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (4999, 1, 0), (4999, 2, 1), (4999, 3, 2)]


def test_few_lists_are_read_where_vectors_have_clusters():
    rng = np.random.default_rng(4)
    centre = 5 * rng.standard_normal((50, 16))
    x = centre[rng.integers(0, 50, 5000)] + rng.standard_normal((5000, 16))
    largest = float((x * x).sum(axis=1).max())
    centres = ann._centres(ann._lift(x, largest), 140)
    assert ann.probes_for(x, centres, largest, 20, 0.96) < 20
    y = rng.standard_normal((5000, 64))
    assert ann.probes_for(y, ann._centres(ann._lift(y, 150.0), 140), 150.0, 20, 0.96) > 50


def test_scan_abandons_candidates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    largest = float((x * x).sum(axis=1).max())
    rotation = ann._rotation(65)
    q = x[:5]
    s = np.sort(q @ x.T, axis=1)[:, -21]
    limits = (q * q).sum(axis=1) + largest - 2 * s
    i, j, score, read, whole = ann.scan(q, limits, list(range(5)), np.arange(2000), x, 20, largest, rotation)
    want = brute(x, range(5), 20)
    hit = sum(len(set(j[i == k]) & set(want[k])) for k in range(5))
    assert read < whole and hit >= 95
