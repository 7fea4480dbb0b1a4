"""Every query with an oracle against DuckDB on the same tables."""

import importlib
import os
from pathlib import Path

import duckdb
import pytest

from strataform.plans import catalogue

#: Queries that SQL doesn't express, and the test that holds what they are made of against a plain model.
HELD = {
    "guard_events": ("tests.test_recurrent", "test_guard_equals_a_plain_model"),
    "pca_latent": ("tests.test_recurrent", "test_components_equal_a_plain_decomposition"),
    "twin_states": ("tests.test_recurrent", "test_twins_equal_a_plain_model_and_the_stream"),
    "kmeans_clusters": ("tests.test_recurrent", "test_clusters_equal_plain_rounds"),
}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_oracle(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE:
        assert name in HELD and hasattr(importlib.import_module(HELD[name][0]), HELD[name][1])
        return
    want = oracle.sql(catalogue.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda f: sorted(map(tuple, f[columns].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"}).to_numpy().tolist()))
    a, b = key(got), key(want)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:5]
