import math

import pytest
from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.functions.breaks import pretty_edges, sturges_bins
from panelyard.functions.numeric import log1p_of, log_of, ratio, to_double, to_int
from panelyard.operators.columns import (
    add_terms, build_level_index, build_ratio_index, columns_at, columns_between, lower_names, minmax, nan_to_null,
    rescale, scatter_table, tag, tolerant_double,
)


def one(spark, expr, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_logs_of_numbers_without_one_are_null(spark):
    for v in (0.0, -1.0, None):
        assert one(spark, log_of("x"), v) is None
    assert one(spark, log1p_of("x"), -1.0) is None
    assert one(spark, log_of("x"), math.e) == pytest.approx(1)


def test_strict_logs_keep_infinity_and_nan(spark):
    assert one(spark, log_of("x", strict=True), 0.0) == -math.inf
    assert math.isnan(one(spark, log_of("x", strict=True), -2.0))
    assert one(spark, log_of("x", strict=True), None) is None
    assert one(spark, log1p_of("x", strict=True), -1.0) == -math.inf
    assert math.isnan(one(spark, log1p_of("x", strict=True), -3.0))


def test_tolerant_casts(spark):
    assert one(spark, to_double("x"), "1.5", "string") == 1.5
    assert one(spark, to_double("x"), "abc", "string") is None
    assert one(spark, to_double("x"), "NaN", "string") is None
    assert one(spark, to_int("x"), "1990", "string") == 1990
    assert one(spark, to_int("x"), "y", "string") is None


def test_ratio_over_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, 2.0, None]


def test_ratio_index_of_one_known_entity(spark):
    df = spark.createDataFrame([(86558132.0, 41662251.0)], "value double, employed double")
    assert build_ratio_index(df, "value", "employed").first()["index_log"] == pytest.approx(
        math.log(86558132 / 41662251)
    )


def test_level_index(spark):
    df = build_level_index(spark.createDataFrame([(2.0,), (0.0,)], "t double"), "t")
    assert rows(df) == [(0.0, 0.0, None), (2.0, 2.0, math.log(2))]


def test_minmax_with_given_and_own_bounds(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (None,)], "x double")
    assert [r[1] for r in minmax(df, "x", 0.0, 10.0).collect()] == [0.1, 0.3, 0.5, None]
    assert [r[1] for r in minmax(df, "x").collect()] == [0.0, 0.5, 1.0, None]
    constant = spark.createDataFrame([(2.0,)], "x double")
    assert minmax(constant, "x").first()[1] is None


def test_column_lists(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "ID int, X1 int, X2 int, Y int")
    low = lower_names(df)
    assert low.columns == ["id", "x1", "x2", "y"]
    assert columns_between(low, "x1", "x2") == ["x1", "x2"]
    assert columns_at(low, 2, 3) == ["x1", "x2"]
    with pytest.raises(ValueError):
        columns_between(low, "y", "x1")


def test_small_helpers(spark):
    df = spark.createDataFrame([("2", float("nan"))], "a string, b double")
    assert rows(nan_to_null(tolerant_double(df, "a"), "b")) == [(2.0, None)]
    assert rows(tag(rescale(tolerant_double(df, "a").select("a"), "a", 1000), scenario="Baseline")) == [
        (2000.0, "Baseline")
    ]
    terms = add_terms(tolerant_double(df, "a"), {"sq": F.col("a") * F.col("a")})
    assert rows(scatter_table(terms, F.col("a"), F.col("sq"))) == [(2.0, 4.0)]


def test_pretty_edges():
    assert pretty_edges(0, 10, 5) == ([0, 2, 4, 6, 8, 10], 2)
    assert pretty_edges(1.3, 8.9, 20)[0][0] == 1.0
    for lo, hi, n in ((-3.2, 17.8, 20), (0.001, 0.0199, 7), (5, 5, 4), (-1e6, 1e6, 13)):
        edges, _ = pretty_edges(lo, hi, n)
        assert edges[0] <= lo and edges[-1] >= hi
        assert len(edges) <= 2.5 * n + 2
    assert sturges_bins(1000) == 11
