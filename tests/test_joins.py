import pytest
from pyspark.errors import PySparkException

from panel_rows import rows
from panelyard.operators.figures import cutoff_lines
from panelyard.operators.joins import (
    attach_baseline, attach_dim, choropleth_table, cutoff_grid, join_panel, resolve_entity, unresolved_names,
)
from panelyard.operators.reshape import melt_years, pivot_mean
from panelyard.operators.sets import distinct_values, union_fill, with_order_key


def test_join_panel_null_keys(spark):
    left = spark.createDataFrame([("A", 1), (None, 2)], "code string, year int")
    right = spark.createDataFrame([("A", 1, 5.0), (None, 2, 6.0)], "code string, year int, v double")
    assert rows(join_panel(left, right, ["code", "year"])) == [("A", 1, 5.0), (None, 2, None)]
    assert rows(join_panel(left, right, ["code", "year"], null_safe=True)) == [("A", 1, 5.0), (None, 2, 6.0)]


def test_attach_dim_wants_one_row_per_key(spark):
    df = spark.createDataFrame([("A", 1), ("C", 2)], "code string, n int")
    dim = spark.createDataFrame([("A", "x"), ("B", "y")], "code string, region string")
    assert rows(attach_dim(df, dim, "code")) == [("A", 1, "x"), ("C", 2, None)]
    twice = dim.union(spark.createDataFrame([("A", "z")], "code string, region string"))
    with pytest.raises(PySparkException, match="several dimension rows for code = A"):
        attach_dim(df, twice, "code").collect()
    assert rows(attach_dim(df, twice, "code", fanout=True)) == [("A", 1, "x"), ("A", 1, "z"), ("C", 2, None)]


def test_attach_baseline_does_not_multiply_rows(spark):
    means = spark.createDataFrame([("x", 1.0), (None, 2.0), ("z", 3.0)], "region string, m double")
    base = spark.createDataFrame([("x", 7.0)] * 50 + [(None, 8.0)] * 20, "region string, b double")
    assert rows(attach_baseline(means, base, "region", "b")) == [("x", 1.0, 7.0), ("z", 3.0, None), (None, 2.0, 8.0)]


def test_resolve_entity_by_normal_name(spark):
    raw = spark.createDataFrame([("  CÔTE d'Ivoire ",), ("Viet Nam",), ("Atlantis",), (None,)], "name string")
    aliases = spark.createDataFrame(
        [("Côte d’Ivoire", "CIV"), ("côte d'ivoire", "CIV"), ("Viet-Nam", "VNM")], "alias string, countrycode string"
    )
    got = {r["name"]: r["countrycode"] for r in resolve_entity(raw, "name", aliases).collect()}
    assert got == {"  CÔTE d'Ivoire ": "CIV", "Viet Nam": "VNM", "Atlantis": None, None: None}


def test_choropleth_keeps_every_vertex_in_order(spark):
    shapes = spark.createDataFrame([("b", "B", 2), ("b", "B", 1), ("a", "A", 1)], "id string, iso3 string, `order` int")
    values = spark.createDataFrame([("B", 5.0)], "iso3 string, value double")
    got = [(r["id"], r["order"], r["value"]) for r in choropleth_table(values, shapes, "iso3").collect()]
    assert got == [("a", 1, None), ("b", 1, 5.0), ("b", 2, 5.0)]


def test_cutoffs(spark):
    regions = spark.createDataFrame([("Europe",), ("Asia",)], "region string")
    cuts = [("High", 3.0), ("Low", 1.0)]
    assert len(rows(cutoff_grid(regions, cuts))) == 4
    assert rows(cutoff_lines(regions, cuts, [(["Europe"], "Low")])) == [
        ("Asia", "High", 3.0), ("Asia", "Low", 1.0), ("Europe", "High", 3.0),
    ]


def test_sets(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([(2.0, "y")], "b double, k string")
    assert rows(union_fill(a, b)) == [("x", 1, None), ("y", None, 2.0)]
    assert rows(distinct_values(a.union(a), "k")) == [("x",)]
    keyed = with_order_key(union_fill(a, b).select("k"), "k", ["y", "x"])
    assert rows(keyed) == [("x", 2), ("y", 1)]
    assert rows(with_order_key(a.select("k"), "k", ["y"], reverse=True)) == [("x", None)]


def test_melt_and_pivot(spark):
    wide = spark.createDataFrame([("A", 1.0, None), ("B", None, 4.0)], "code string, x1960 double, x1961 double")
    long = melt_years(wide, ["code"], ["x1960", "x1961"], "v")
    assert rows(long) == [("A", 1960, 1.0), ("A", 1961, None), ("B", 1960, None), ("B", 1961, 4.0)]
    again = pivot_mean(long, ["code"], "year", "v", [1960, 1961, 1999])
    assert rows(again) == [("A", 1.0, None, None), ("B", None, 4.0, None)]


def test_unresolved_names(spark):
    aliases = spark.createDataFrame([("Viet Nam", "VNM")], "alias string, countrycode string")
    raw = spark.createDataFrame([("viet-nam",), ("Atlantis",), ("Atlantis",), (None,)], "name string")
    assert rows(unresolved_names(raw, "name", aliases)) == sorted([("Atlantis", 2), (None, 1)], key=repr)


def test_choropleth_needs_one_value_per_entity(spark):
    values = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "iso3 string, value double")
    shapes = spark.createDataFrame([("s", 1, "A")], "id string, order int, iso3 string")
    with pytest.raises(Exception):
        choropleth_table(values, shapes, "iso3").collect()
    one = choropleth_table(values.limit(1), shapes, "iso3", whole=False)
    assert one.count() == 1
