import pytest
from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.operators.filters import (
    complete_cases, exclude, exclude_listed, exclude_where, keep_groups_with_data, period_between, period_grid,
)

NAN = float("nan")


@pytest.fixture()
def codes(spark):
    return spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "code string, n int")


def test_exclusions_keep_null(spark, codes):
    assert rows(exclude(codes, "code", ["A"])) == [("B", 2), (None, 3)]
    listed = spark.createDataFrame([("A",), ("A",), (None,)], "x string")
    assert rows(exclude_listed(codes, "code", listed)) == [("B", 2), (None, 3)]
    assert rows(exclude_where(codes, (F.col("code") == "B") & (F.col("n") == 2))) == [("A", 1), (None, 3)]


def test_periods(spark):
    df = spark.createDataFrame([(y,) for y in range(2018, 2032)] + [(None,)], "year int")
    assert [r[0] for r in rows(period_grid(df, "year", 2020, 2100, 5))] == [2020, 2025, 2030]
    assert [r[0] for r in rows(period_between(df, "year", 2029, 2030))] == [2029, 2030]


def test_complete_cases(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None), ("C", NAN), (None, 2.0)], "code string, v double")
    assert rows(complete_cases(df)) == [("A", 1.0)]
    assert rows(complete_cases(df, ["code"]).select("code")) == [("A",), ("B",), ("C",)]


def test_groups_with_data_keeps_whole_groups(spark):
    df = spark.createDataFrame(
        [("A", 1.0, 1.0), ("A", None, 1.0), ("B", None, 1.0), ("B", NAN, 2.0), (None, 3.0, 3.0), (None, None, None)],
        "code string, x double, y double",
    )
    kept = keep_groups_with_data(df, ["code"], ["x", "y"])
    assert sorted((r[0] or "-", r[1] or 0) for r in kept.collect()) == [("-", 0), ("-", 3.0), ("A", 0), ("A", 1.0)]
