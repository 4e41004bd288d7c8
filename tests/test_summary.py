import random
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.operators import ranges, selection, sizing
from panelyard.operators.diagnostics import bh_adjust
from panelyard.operators.ranks import cumulative_counts
from panelyard.operators.summary import (
    count_above, density_column, describe_index, extreme_entity, histogram_table, key_figures, normal_density,
    summary_table,
)

POINTS = [0, 0.25, 0.5, 0.75, 1]


def frame(spark, values, **more):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


def test_figures(spark):
    df = spark.createDataFrame(
        [("A", 1.0), ("B", 5.0), ("C", 5.0), ("D", None), ("E", float("nan")), ("F", 1.0)], "k string, v double"
    )
    assert rows(describe_index(df, "v"))[0] == (3.0, pytest.approx(np.std([1, 5, 5, 1], ddof=1)))
    assert rows(extreme_entity(df, "v", "k")) == [("B", "A")]
    assert rows(count_above(df, "v")) == [(2,)]
    assert rows(count_above(df, "v", 0.5)) == [(4,)]
    r = key_figures(df, "v", "k").first()
    assert (r["mean"], r["highest"], r["lowest"], r["n_above"], r["n_entities"]) == (3.0, "B", "A", 2, 6)


def check_summary(spark, columns):
    names = [f"c{i}" for i in range(len(columns))]
    data = [tuple(None if v is None else float(v) for v in r) for r in zip(*columns)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    got = {r["column"]: r for r in summary_table(df, names).collect()}
    for n, col in zip(names, columns):
        known = np.array([x for x in col if x is not None])
        assert got[n]["n_null"] == len(col) - len(known)
        if len(known):
            want = np.quantile(known, POINTS)
            assert [got[n][c] for c in ("min", "q1", "median", "q3", "max")] == pytest.approx(list(want))
            assert got[n]["mean"] == pytest.approx(known.mean())
        else:
            assert got[n]["median"] is None


def test_summary_table(spark):
    rng = np.random.default_rng(1)
    check_summary(spark, [
        list(rng.normal(size=501)), [3.0] * 501, [None] * 501, [None] * 500 + [2.0],
        [float(x) for x in rng.integers(0, 4, 501)],
    ])


def test_summary_table_of_awkward_values(spark):
    """A third of the rows are one value; both zeros, both infinities, neighbours in the last bit."""
    rng = np.random.default_rng(2)
    values = list(rng.normal(size=2000)) + [0.25] * 1000
    close = [float(np.nextafter(1.0, 2.0)) if i % 2 else 1.0 for i in range(3000)]
    wide = [float(x) for x in np.r_[10.0 ** rng.uniform(-300, 300, 1500), -(10.0 ** rng.uniform(-300, 300, 1499)), 0.0]]
    check_summary(spark, [values, list(rng.exponential(size=3000)), close, wide, [0.0, -0.0, 1.0] * 1000])
    ends = spark.createDataFrame([(float("inf"),)] * 6 + [(float("-inf"),)] * 3 + [(1.0,)], "v double")
    r = summary_table(ends, ["v"]).first()
    assert (r["min"], r["median"], r["q3"], r["max"]) == (float("-inf"), float("inf"), float("inf"), float("inf"))


def test_order_keys():
    rng = np.random.default_rng(7)
    values = np.r_[rng.normal(size=500), 10.0 ** rng.uniform(-320, 308, 500), -(10.0 ** rng.uniform(-320, 308, 500)), 0.0, np.inf, -np.inf]
    keys = selection.order_keys(values)
    assert (np.argsort(keys, kind="stable") == np.argsort(values, kind="stable")).all()
    assert (selection.key_values(keys) == values).all()
    assert selection.order_keys(np.array([-0.0])) == selection.order_keys(np.array([0.0]))


@pytest.mark.parametrize("values", ["rounded", "one digit"])
def test_select_ranks(spark, monkeypatch, values):
    """Values that differ in their last digit only take a pass for every digit."""
    passes, made = [], selection._counters
    monkeypatch.setattr(selection, "_counters", lambda *a: passes.append(a[2:]) or made(*a))
    rng = np.random.default_rng(9)
    n = 5000 if values == "rounded" else 1_100_000
    a = np.round(rng.normal(size=n), 2) if values == "rounded" else (np.float64(1.5).view(np.int64) + rng.integers(0, 9, n)).view(np.float64)
    ids = spark.createDataFrame(pd.DataFrame({"i": np.arange(n, dtype=np.int32), "a": a})).repartition(3)
    df = ids.select("a", F.when(F.col("i") % 3 > 0, -F.col("a")).alias("b"))
    known = np.sort(-a[np.arange(n) % 3 > 0])
    ranks = [0, 1, 777, len(known) - 1]
    monkeypatch.setattr(selection, "COUNTERS", 100_000)
    got = selection.select_ranks(df, [ranks, ranks])
    assert [got[0][r] for r in ranks] == np.sort(a)[ranks].tolist() and [got[1][r] for r in ranks] == known[ranks].tolist()
    assert len(passes) == (2 if values == "rounded" else 4)


def test_ten_million_rows_with_heavy_ties(spark):
    """Nothing is kept: no cached table, and counters only on the way."""
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % n) / 1024).alias("v"))
    before = len(sizing._KEPT)
    row = summary_table(df, ["v"]).first()
    values = np.sort(np.where(np.arange(n) % 3 == 0, 0.5, (np.arange(n) * 7919 % n) / 1024))
    assert [row[c] for c in ("min", "q1", "median", "q3", "max")] == np.quantile(values, POINTS).tolist()
    assert len(sizing._KEPT) == before


def test_numbered_ranges_split_ties(spark):
    """All rows in three values: ranges stay within the bound, in order."""
    df = spark.range(6000).select((F.col("id") % 3).alias("v"), "id")
    ranged = ranges.numbered_ranges(df, [F.col("v"), F.col("id")], ranges.range_count(6000, 500))
    found = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi"))
    found = sorted(found.collect(), key=lambda r: r["_range"])
    assert len(found) > 12 and max(r["n"] for r in found) <= 500
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))


def test_cumulative_counts_over_blocks(spark):
    rng = np.random.default_rng(3)
    pairs = [(str(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 80, 500))] + [("0", None)]
    df = spark.createDataFrame(pairs, "g string, v double")
    table, total, blocks = cumulative_counts(df, "v", ["g"], block_rows=20)
    assert total == 500 and blocks > 1
    for r in table.collect():
        group = [v for g, v in pairs if g == r["g"] and v is not None]
        assert r["cnt"] == sum(v == r["v"] for v in group)
        assert r["cum"] == sum(v <= r["v"] for v in group)


def bh(p):
    """Benjamini-Hochberg by its definition."""
    p = np.asarray(p)
    order = np.argsort(p)
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    out = np.empty(len(p))
    out[order] = q
    return out


@pytest.mark.parametrize("block_rows", [10, 10**6])
def test_bh_adjust(spark, block_rows):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(size=300) ** 2, 3)   # with ties
    p[:100] = 0.5                                 # one value holds a third
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in bh_adjust(df, "p", block_rows=block_rows).collect()}
    assert got.pop(999) is None
    assert [got[i] for i in range(300)] == pytest.approx(list(bh(p)))


def test_bh_adjust_by_group(spark):
    rng = np.random.default_rng(5)
    data = [(str(g), i, float(p)) for i, (g, p) in enumerate(zip(rng.integers(0, 3, 90), rng.uniform(size=90)))]
    df = spark.createDataFrame(data, "g string, i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in bh_adjust(df, "p", ["g"], block_rows=7).collect()}
    for g in "012":
        ids = [i for h, i, _ in data if h == g]
        assert [got[i] for i in ids] == pytest.approx(list(bh([data[i][2] for i in ids])))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_bh_is_monotone_and_not_below_p(spark, p):
    df = spark.createDataFrame([(float(v),) for v in p], "p double")
    got = sorted((r["p"], r["p_adjusted"]) for r in bh_adjust(df, "p").collect())
    assert all(q >= v - 1e-12 and q <= 1 for v, q in got)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(got, got[1:]))


def test_histogram_counts_every_value_once(spark):
    values = [0.0, 0.5, 1.0, 1.0, 1.5, 2.0, 10.0]
    table = histogram_table(frame(spark, [*values, None, float("nan")]), "v", 5).collect()
    table.sort(key=lambda r: r["bin"])
    assert [r["lower"] for r in table] == [0, 2, 4, 6, 8]
    assert [r["count"] for r in table] == [6, 0, 0, 0, 1]   # 2.0 belongs to the bin it closes
    assert sum(r["density"] * (r["upper"] - r["lower"]) for r in table) == pytest.approx(1)
    assert histogram_table(frame(spark, values), "v", None).count() >= 3


def test_normal_density(spark):
    df = frame(spark, [1, 2, 3, 4, 10])
    curve = normal_density(df, "v").orderBy("point").collect()
    assert len(curve) == 88 and (curve[0]["x"], curve[-1]["x"]) == (1.0, 10.0)
    m, s = np.mean([1, 2, 3, 4, 10]), np.std([1, 2, 3, 4, 10], ddof=1)
    assert curve[40]["density"] == pytest.approx(
        np.exp(-0.5 * ((curve[40]["x"] - m) / s) ** 2) / (s * np.sqrt(2 * np.pi))
    )
    peak = density_column(df.union(frame(spark, [None])), "v").agg(F.max("density"), F.count("density")).first()
    assert peak[1] == 5 and peak[0] <= 1 / (s * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("values,bins", [
    ([-40.6, -39.2, -37.8, -37.8], 20), ([0.1 * i for i in range(11)], 10), ([0.0, 0.0], 5), ([1e-3, 3e-3, 7e-3, 0.02], None),
])
def test_histogram_keeps_every_value(spark, values, bins):
    table = histogram_table(spark.createDataFrame([(v,) for v in values], "v double"), "v", bins).collect()
    assert sum(r["count"] for r in table) == len(values)


def test_histogram_bins_are_closed_on_the_right(spark):
    rng = random.Random(8)
    for _ in range(12):
        digits = rng.randint(1, 3)
        values = [round(rng.uniform(-50, 50), digits) for _ in range(60)]
        table = histogram_table(spark.createDataFrame([(v,) for v in values], "v double"), "v", 20).collect()
        upper, step = [r["upper"] for r in table], table[0]["upper"] - table[0]["lower"]
        want = [0] * len(table)
        for v in values:
            want[min(len(table) - 1, sum(u + 1e-7 * step < v for u in upper))] += 1
        assert [r["count"] for r in sorted(table, key=lambda r: r["bin"])] == want


def test_bh_leaves_out_nan_and_null(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (float("nan"),), (None,), (None,)], "p double")
    got = [r["p_adjusted"] for r in bh_adjust(df, "p").collect()]
    assert sorted(x for x in got if x is not None) == pytest.approx([0.02, 0.02]) and got.count(None) == 3
