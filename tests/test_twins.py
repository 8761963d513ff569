"""Every registered query next to its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import TABLES, close, rows_of  # noqa: E402

from wardlight.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SLOW_WITHOUT_TWIN = {"J18_fit_ensemble", "J22_platt_calibration", "J23_grid_search_cv", "J30_modality_ablation"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_twin(spark, db, name):
    got, want = QUERIES[name].run(spark, SF).toPandas(), db.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    far = [(x, y) for x, y in zip(a, b) if x != y and not all(close(u, v) for u, v in zip(x, y))]
    assert not far, far[:2]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql and n not in SLOW_WITHOUT_TWIN])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
