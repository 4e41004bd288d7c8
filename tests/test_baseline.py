import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.operators import sizing
from panelyard.operators import baseline
from panelyard.operators.baseline import (
    baseline_average, baseline_by_group, entity_snapshot, group_bounds, lag_rows, with_group_stats,
)
from panelyard.operators.sizing import attach_stats

PANEL = [
    ("A", 1999, 9.0), ("A", 2000, 1.0), ("A", 2005, 3.0), ("A", 2011, 9.0),
    ("B", 2004, 4.0), ("B", 2005, None), ("C", 2003, 7.0), (None, 2005, 5.0), (None, 2006, float("nan")),
]


@pytest.fixture()
def panel(spark):
    return spark.createDataFrame(PANEL, "code string, year int, v double")

from panelyard.session import size_in_bytes


def test_baseline_average(panel):
    out = baseline_average(panel, "code", "year", {"v": "average"}, (2000, 2010), 2005)
    assert rows(out) == [("A", 2005, 3.0, 2.0), ("B", 2005, None, 4.0), (None, 2005, 5.0, 5.0)]


def test_baseline_by_group(panel):
    out = baseline_by_group(panel, "code", "v", period="year", years=(2000, 2010), collapse=True)
    got = {r["code"]: (r["baseline"], r["exp_baseline"]) for r in out.collect()}
    assert got["A"] == (2.0, pytest.approx((math.e + math.e**3) / 2))   # mean of exp, not exp of mean
    assert got[None][0] == 5.0
    kept = baseline_by_group(panel, "code", "v", drop_null_group=True)
    assert kept.count() == 7
    assert {r["code"]: r["baseline"] for r in kept.collect()} == {"A": 5.5, "B": 4.0, "C": 7.0}
    bounds = group_bounds(kept, "code", "baseline")
    assert rows(bounds) == [("A", 5.5, 5.5), ("B", 4.0, 4.0), ("C", 7.0, 7.0)]


def test_group_stats_replace_a_column(panel):
    out = with_group_stats(panel.withColumn("m", F.lit(0)), "code", {"m": F.max("year")})
    assert {(r["code"], r["m"]) for r in out.collect()} == {("A", 2011), ("B", 2005), ("C", 2003), (None, 2006)}
    assert out.count() == len(PANEL)


def test_snapshot(panel):
    assert rows(entity_snapshot(panel, "code", "A", "year", 2005, {"v": "mean_v"})) == [(3.0,)]
    assert rows(entity_snapshot(panel, "code", "Z", "year", 2005, {"v": "mean_v"})) == [(None,)]


def test_lag_counts_rows_not_periods(spark):
    df = spark.createDataFrame([("A", y, float(y)) for y in (1990, 1991, 1995, 2003)] + [("B", 1990, 1.0)], "code string, year int, v double")
    got = {(r["code"], r["year"]): r["v_lag"] for r in lag_rows(df, "code", "year", "v", 2).collect()}
    assert got == {("A", 1990): None, ("A", 1991): None, ("A", 1995): 1990.0, ("A", 2003): 1991.0, ("B", 1990): None}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_lag_of_a_hot_entity_equals_the_window(spark, n):
    rng = random.Random(3)
    hot = [("hot", p, rng.random()) for p in rng.sample(range(10_000), 400)]
    cold = [(f"e{i}", p, rng.random()) for i in range(40) for p in rng.sample(range(10_000), rng.randint(1, 9))]
    unkeyed = [(None, p, rng.random()) for p in range(30)]
    df = spark.createDataFrame(hot + cold + unkeyed, "code string, year int, v double")
    plain = df.withColumn("v_lag", F.lag("v", n).over(Window.partitionBy("code").orderBy("year")))
    spread = lag_rows(df, "code", "year", "v", n, window_rows=37)
    assert rows(spread) == rows(plain)


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(sizing, "HOT_KEYS", 1)
    data = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(60)] + [(None, 1)] * 40
    df = spark.createDataFrame(data, "k string, v int")
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    salted = attach_stats(df, stats, ["k"], weight="n", rows_per_task=20, small=False)
    plain = attach_stats(df, stats, ["k"], weight="n")
    assert rows(salted.select("k", "v", "n", "total")) == rows(plain.select("k", "v", "n", "total"))
    assert salted.count() == len(data)


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "string"])
def test_lag_of_any_period_type_at_any_block_size(spark, kind):
    data = [("a", i % 50, float(i)) for i in range(90)] + [("b", i, float(-i)) for i in range(7)] + [("a", None, 5.0), (None, 3, 1.0), (None, 4, 2.0)]
    df = spark.createDataFrame(data, "code string, step int, v double")
    period = {
        "int": F.col("step"), "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("step")),
        "timestamp": F.timestamp_seconds(F.col("step") * 1000), "string": F.lpad(F.col("step").cast("string"), 4, "0"),
    }[kind]
    df = df.withColumn("t", period)
    for n in (0, 1, 3):
        want = rows(lag_rows(df, "code", "t", "v", n))
        for window_rows in (5, 13):
            assert rows(lag_rows(df, "code", "t", "v", n, window_rows=window_rows)) == want


def test_size_settings():
    assert [size_in_bytes(x) for x in ("10485760b", "10m", "256k", "-1", "1g")] == [10485760, 10485760, 262144, -1, 1 << 30]


@pytest.mark.parametrize("n", [1, 5, 40])
def test_lag_of_an_entity_with_all_rows_in_three_periods(spark, monkeypatch, n):
    """Ranges end within periods, and within equal rows; none holds more than was allowed."""
    rng, sizes, made = random.Random(4), [], baseline.numbered_ranges
    data = [("hot", i % 3, rng.random()) for i in range(1500)] + [("hot", 1, 0.5)] * 500
    data += [(f"e{i}", p, rng.random()) for i in range(60) for p in range(rng.randint(1, 6))]
    df = spark.createDataFrame(data, "code string, year int, v double").repartition(3)

    def watched(*args):
        ranged = made(*args)
        sizes.extend(r["count"] for r in ranged.groupBy("_range").count().collect())
        return ranged

    monkeypatch.setattr(baseline, "numbered_ranges", watched)
    plain = df.withColumn("v_lag", F.lag("v", n).over(Window.partitionBy("code").orderBy("year", "v")))
    assert rows(lag_rows(df, "code", "year", "v", n, window_rows=100)) == rows(plain)
    assert len(sizes) > 20 and max(sizes) <= 100
