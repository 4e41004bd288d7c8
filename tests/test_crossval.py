import random
import numpy as np
import pytest

from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.operators import ranks
from panelyard.operators.crossval import assign_folds, cv_report, cv_rmse, fold_index, fold_roles, make_folds


def make(seed=0, n=25):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        alpha = rng.normal()
        for t in range(1990, 2003):
            if t == 1996 or rng.uniform() < 0.3:   # no entity has 1996: a gap in the time axis
                continue
            x = rng.normal(size=2) + alpha * 0.2
            y = 1 + alpha + x @ [0.5, -0.8] + rng.normal() * 0.3
            out.append((f"e{i}", t, float(y) if rng.uniform() > 0.05 else None, float(x[0]), float(x[1])))
    # An entity seen only in a few neighbouring periods drops out of some training sets.
    out += [("short", t, float(t - 1990), float(t % 3), 1.0) for t in (1993, 1994, 1995)]
    return out


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture()
def df(spark, data):
    return spark.createDataFrame(data, "entity string, year int, y double, a double, b double")


def within_slopes(sample):
    ids = np.array([r[0] for r in sample])
    y = np.array([r[2] for r in sample])
    x = np.array([r[3:] for r in sample])
    for m in set(ids):
        y[ids == m] -= y[ids == m].mean()
        x[ids == m] -= x[ids == m].mean(0)
    return np.linalg.lstsq(x, y, rcond=None)[0]


def between_slopes(sample):
    years = sorted({r[1] for r in sample})
    ym = np.array([np.mean([r[2] for r in sample if r[1] == t]) for t in years])
    zm = np.array([[1.0, *np.mean([r[3:] for r in sample if r[1] == t], axis=0)] for t in years])
    return np.linalg.lstsq(zm, ym, rcond=None)[0][1:]


def expected(data, folds, slopes, cols=2):
    out = {}
    for f, chunk in folds.items():
        train = [r for r in data if r[1] < chunk[0] or r[1] > chunk[-1]]
        test = [r for r in data if r[1] in chunk]
        known = lambda part: [(*r[:3], *r[3:3 + cols]) for r in part if r[2] is not None]
        b = slopes(known(train))
        rmse = lambda part: float(np.sqrt(np.mean([(r[2] - np.dot(r[3:], b)) ** 2 for r in known(part)])))
        out[f] = (len(train), len(test), b, rmse(train), rmse(test))
    return out


def compare(got, want, names=("b_a", "b_b")):
    assert set(got) == set(want)
    for f, (n_train, n_test, b, e_train, e_test) in want.items():
        r = got[f]
        assert (r["n_train"], r["n_test"], r["status"]) == (n_train, n_test, "ok")
        assert [r[c] for c in names] == pytest.approx(list(b), rel=1e-6)
        assert (r["rmse_train"], r["rmse_test"]) == (pytest.approx(e_train), pytest.approx(e_test))


def contiguous(data, width=5):
    years = sorted({r[1] for r in data})
    return {i + 1: years[i:i + width] for i in range(len(years) - width + 1)}


def test_make_folds_are_windows_of_present_periods(df, data):
    got = {}
    for fold, pos, period in rows(make_folds(df, "year")):
        got.setdefault(fold, {})[pos] = period
    assert {f: [p[i] for i in sorted(p)] for f, p in got.items()} == contiguous(data)
    assert make_folds(df, "year", 50).count() == 0


def test_assign_folds(df, data):
    marked = assign_folds(df, make_folds(df, "year"), "year").collect()
    for f, chunk in contiguous(data).items():
        mine = [r for r in marked if r["fold"] == f]
        assert len(mine) == len(data)
        assert sum(r["in_test"] for r in mine) == sum(r[1] in chunk for r in data)
        assert all(r["in_train"] != r["in_test"] for r in mine if not chunk[0] < r["year"] < chunk[-1])


def test_within_folds(df, data):
    got = {r["fold"]: r for r in cv_rmse(df, "y", ["a", "b"], "entity", "year").collect()}
    compare(got, expected(data, contiguous(data), within_slopes))


def test_between_period_folds(df, data):
    got = {r["fold"]: r for r in cv_rmse(df, "y", ["a"], "entity", "year", model="between_period", min_rows=1).collect()}
    compare(got, expected(data, contiguous(data), between_slopes, cols=1), names=("b_a",))


def test_given_folds_may_be_unsorted_and_overlap(spark, df, data):
    """As drawn at random: limits come from the first and last listed period, a listed
    period may not exist, and limits the wrong way round leave every row in training."""
    chunks = {1: [1997, 1991, 2001, 1994, 1999], 2: [2000, 1993, 1990, 1998, 1992], 3: [1991, 2005, 1996, 1990, 1998]}
    folds = spark.createDataFrame(
        [(f, i, p) for f, c in chunks.items() for i, p in enumerate(c, 1)], "fold int, pos int, period int"
    )
    got = {r["fold"]: r for r in cv_rmse(df, "y", ["a", "b"], "entity", "year", folds=folds).collect()}
    compare(got, expected(data, chunks, within_slopes))


def test_guards(spark, df):
    few = cv_rmse(df, "y", ["a"], "entity", "year", min_rows=10_000).collect()
    assert {r["status"] for r in few} == {"too_few_rows"} and all(r["rmse_test"] is None for r in few)
    flat = spark.createDataFrame(
        [("A", t, float(t), 1.0) for t in range(12)], "entity string, year int, y double, a double"
    )
    none = cv_rmse(flat, "y", ["a"], "entity", "year", min_rows=1)
    assert {r["status"] for r in none.collect()} == {"no_fit"}
    report = cv_report(none).first()
    assert (report["folds_used"], report["mean_rmse_test"], report["verdict"]) == (0, None, None)
    chunk = spark.createDataFrame([(1, i, 3000 + i) for i in range(1, 6)], "fold int, pos int, period int")
    assert [r["status"] for r in cv_rmse(flat, "y", ["a"], "entity", "year", folds=chunk).collect()] == ["empty"]


def test_report(spark):
    errors = spark.createDataFrame(
        [(1, "ok", 1.0, 2.0), (2, "ok", 2.0, 4.0), (3, "too_few_rows", None, None)],
        "fold int, status string, rmse_train double, rmse_test double",
    )
    assert rows(cv_report(errors)) == [(2, 1.5, 3.0, "train_better")]


def test_errors_of_terms_on_a_large_level(spark):
    """Slopes fit a response of the size of its noise; levels of 1e8 must not swallow it."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(40):
        for t in range(1990, 2003):
            x = 1e8 + 1e7 * rng.normal()
            data.append((f"e{i}", t, float(0.5 * x + 0.01 * rng.normal()), float(x)))
    df = spark.createDataFrame(data, "entity string, year int, y double, a double")
    got = {r["fold"]: r for r in cv_rmse(df, "y", ["a"], "entity", "year").collect()}
    for f, (_, _, b, e_train, e_test) in expected(data, contiguous(data), within_slopes, cols=1).items():
        assert got[f]["b_a"] == pytest.approx(b[0], rel=1e-12)
        assert got[f]["rmse_train"] == pytest.approx(e_train, rel=1e-3) and 0.005 < e_train < 0.02
        assert got[f]["rmse_test"] == pytest.approx(e_test, rel=1e-3)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e8])
def test_slopes_when_left_out_rows_are_on_a_larger_scale(spark, scale):
    rng = np.random.default_rng(6)
    data = []
    for i in range(40):
        for t in range(1990, 2003):
            x = rng.normal() * (scale if t < 1995 else 1.0)
            data.append((f"e{i}", t, float(0.45 * x + rng.normal() * 0.1), float(x)))
    df = spark.createDataFrame(data, "entity string, year int, y double, a double")
    got = {r["fold"]: r for r in cv_rmse(df, "y", ["a"], "entity", "year").collect()}
    want = within_slopes([r for r in data if r[1] > 1994])
    assert got[1]["status"] == "ok" and got[1]["b_a"] == pytest.approx(want[0], rel=1e-9)


def test_fold_index_lies_where_brute_force_says(spark):
    """Limits that no period has, folds listed backwards, and periods that repeat."""
    draw = random.Random(6)
    axis = sorted(draw.sample(range(0, 400, 2), 120))
    listed = {f: [draw.randrange(-5, 410) for _ in range(5)] for f in range(40)}
    df = spark.createDataFrame([(p,) for p in axis for _ in range(2)] + [(None,)], "year int")
    folds = spark.createDataFrame([(f, i + 1, p) for f, own in listed.items() for i, p in enumerate(own)], "fold int, pos int, period int")
    index, _, _ = fold_index(df, folds, "year")
    for r in index.collect():
        first, last = listed[r["fold"]][0], listed[r["fold"]][-1]
        assert (r["before"], r["after"], r["n"]) == (sum(p < first for p in axis), sum(p <= last for p in axis), len(axis))
    want = []
    for f, own in listed.items():
        for p in axis:
            train, test = p < own[0] or p > own[-1], p in own
            if train or test:
                want.append((f, p, train, test))
    assert sorted(map(tuple, fold_roles(df, folds, "year").collect())) == sorted(want)


def test_many_folds_on_a_long_axis(spark):
    """10^4 periods and 10^4 folds: the index has a row for each, never their product."""
    df = spark.range(10_000).select(F.col("id").cast("int").alias("year"))
    folds = make_folds(df, "year", 3)
    index, axis, members = fold_index(df, folds, "year")
    assert index.count() == 9998 and axis.count() == 10_000 and members.count() == 3 * 9998
    assert index.filter("before <> fold - 1 or after <> fold + 2").count() == 0


def test_make_folds_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks.cumulative_counts, "__defaults__", ((), 10, None))
    df = spark.range(60).select((F.col("id") * 3).cast("int").alias("year"))
    assert sorted(map(tuple, make_folds(df, "year", 5).collect())) == [(f, i, 3 * (f + i - 2)) for f in range(1, 57) for i in range(1, 6)]
