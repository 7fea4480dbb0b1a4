"""Queries against their SQL on tables with keys and groups as larger ones have them."""

import duckdb
import numpy as np
import pytest

from strataform.operators import graph, similarity, simulation, spatial, topology
from strataform.plans import catalogue

PART = "SELECT i::BIGINT AS p_partkey, 'Brand#' || (i % 25) AS p_brand, 'LARGE' AS p_type, (i * 7 % 50 + 1)::INT AS p_size, 900 + (i % 1000) / 10 AS p_retailprice FROM range({0}, {1}) r(i)"


def both(spark, path, name, **tables):
    """Sorted rows of a query, and of its SQL, over tables given as SQL."""
    c = duckdb.connect()
    for table, sql in tables.items():
        c.sql(f"COPY ({sql}) TO '{path}/{table}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, str(path))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_codes_of_keys_beyond_20_bits(spark, tmp_path):
    got, want = both(spark, tmp_path, "morton_keys", part=PART.format(2**20 - 30, 2**20 + 30))
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_not_broadcast(spark, tmp_path):
    """A file of boxes is far smaller than their rows in cells."""
    got, want = both(spark, tmp_path, "grid_overlap_pairs", part=PART.format(0, 400))
    assert got == want and "Broadcast" not in plan(catalogue.QUERIES["grid_overlap_pairs"](spark, str(tmp_path)))


def test_points_and_boxes_are_not_broadcast(spark, tmp_path):
    got, want = both(spark, tmp_path, "point_in_solid", part=PART.format(0, 400))
    assert got == want and "Broadcast" not in plan(catalogue.QUERIES["point_in_solid"](spark, str(tmp_path)))


def test_boxes_of_two_sets_are_not_broadcast(spark, tmp_path):
    got, want = both(spark, tmp_path, "two_set_contacts", part=PART.format(0, 400))
    assert got == want and "Broadcast" not in plan(catalogue.QUERIES["two_set_contacts"](spark, str(tmp_path)))


def test_points_of_a_radius_are_dealt_by_cell(spark, tmp_path):
    got, want = both(spark, tmp_path, "radius_join", part=PART.format(0, 400))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))
    assert "Broadcast" not in plan(catalogue.QUERIES["radius_join"](spark, str(tmp_path)))


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that graphs and cells are written to."""
    seen = []
    for module in (graph, topology):
        monkeypatch.setattr(module, "cut", lambda df, *a, f=module.cut: seen.append(plan(df)) or f(df, *a))
    return seen


def test_pockets_are_not_broadcast(spark, tmp_path, plans):
    got, want = both(spark, tmp_path, "sealed_pockets", part=PART.format(0, 700))
    assert got == want
    plans.append(plan(catalogue.QUERIES["sealed_pockets"](spark, str(tmp_path))))
    assert len(plans) > 5 and not any("Broadcast" in x for x in plans)


def test_fabrication_is_not_broadcast(spark, tmp_path, plans):
    got, want = both(spark, tmp_path, "fabrication_classes", part=PART.format(0, 700))
    assert got == want
    plans.append(plan(catalogue.QUERIES["fabrication_classes"](spark, str(tmp_path))))
    assert len(plans) > 8 and not any("Broadcast" in x for x in plans)


def test_blocks_of_parts_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Packed rows look like a hundred bytes a block."""
    monkeypatch.setattr(similarity, "WIDE", 64)
    got, want = both(spark, tmp_path, "substitute_rank", part=PART.format(0, 700))
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, want))
    found = plan(catalogue.QUERIES["substitute_rank"](spark, str(tmp_path)))
    assert "Join [grp" in found and not any("Broadcast" in x and "block" in x for x in found.split("\n"))


def test_best_of_ties_and_no_numbers():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 8))
        values = [np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 4, n).astype(float)) for _ in range(2)]
        ids, on = rng.permutation(n), np.flatnonzero(rng.random(n) < 0.9)
        want = on[np.lexsort((ids[on], values[1][on], values[0][on]))[:k]]
        assert similarity._best(values, ids, on, k).tolist() == want.tolist()


def test_nearest_on_a_line_needs_no_blocks(spark, monkeypatch):
    """As block by block, with ties, values far from all others and domains without a solved problem."""
    rng = np.random.default_rng(5)
    row = lambda i: (i, int(rng.integers(0, 5)), i % 2, [float(rng.integers(-40, 40)) / 4])
    solved = spark.createDataFrame([r for r in map(row, range(300)) if r[1] < 4 and (r[1] or abs(r[3][0]) > 8)], "id bigint, domain int, regime int, latent array<double>")
    asked = spark.createDataFrame([(*row(i), i % 2 == 0, i % 10 / 10, i % 7 / 7) for i in range(500)], "id bigint, domain int, regime int, latent array<double>, spd boolean, nonlinearity double, mesh_score double")
    blocks = simulation.best_between
    monkeypatch.setattr(simulation, "best_between", None)
    got = sorted(map(str, simulation.route(asked, solved).collect()))
    monkeypatch.setattr(simulation, "best_between", blocks)
    monkeypatch.setattr(simulation, "_on_a_line", lambda df: False)
    assert len(got) == 500 and got == sorted(map(str, simulation.route(asked, solved).collect()))


def test_boxes_that_touch_a_third_cell_by_rounding(spark):
    boxes = spark.createDataFrame([(i, 0.05 * (i / 7), 0.05 * (i / 7) + w) for i in range(200) for w in ((0.05, 0.1, 0.2)[i % 3],)], "id int, min_x double, max_x double")
    rows = [tuple(r) for r in boxes.collect()]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert sorted(map(tuple, spatial.overlap_pairs(boxes, 0.05, ("x",)).collect())) == want
