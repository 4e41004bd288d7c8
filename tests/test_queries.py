"""Registered queries against their SQL at the smallest scale; tools/check_oracle.py runs them all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from panelyard.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

CHECKED = [
    "ratio_index", "exclude_compound", "groups_with_data", "melt_year_columns", "join_two_keys", "dim_fanout",
    "resolve_alias", "choropleth", "scenario_baseline", "entity_baseline", "income_baseline", "lag5",
    "key_index_figures", "histogram", "within", "between_time", "robust_errors", "random_effects",
    "bp_plain", "bp_by_entity", "scenario_projection", "band", "pct_change", "cv_between_time", "fitted_bands",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-5 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    result = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got, want = in_order(df.columns, df.collect()), in_order(names, result.fetchall())
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["entity", "period", "region", "index_log", "average", "baseline", "exp_baseline"]
    assert df.count() > 0


def test_every_panel_query_has_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry_points.queries())
