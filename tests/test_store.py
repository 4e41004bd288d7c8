"""Stored moments against fits of the rows themselves."""

import os

import numpy as np
import pytest
from test_models import XS, make, spark_frame

from panelyard.operators.crossval import cv_rmse
from panelyard.operators.models import fit_between, fit_ols, fit_random, fit_within
from panelyard.operators.moments import merge_moments, moment_columns
from panelyard.operators.store import MomentStore

SCHEMA = "entity string, year int, y double, x1 double, x2 double, x3 double"
BAD = [("e00", 2001, None, 1.0, 1.0, 1.0), ("e01", 2002, 1.0, float("nan"), 1.0, 1.0), (None, 1995, 1.0, 1.0, 2.0, 1.0),
       ("e02", None, 1.5, 1.0, 1.0, 0.5), ("gone", 1993, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    data = make(seed=3, n=40)
    # Rows of a period that come with a later load, and a period with more rows than one.
    return data + [(e, y, v + 0.3, a, b + 0.1, c) for e, y, v, a, b, c in data[::5]] + BAD


@pytest.fixture()
def store(spark, rows, tmp_path):
    out = MomentStore(spark, f"{tmp_path}/store", "y", XS, "entity", "year")
    for name, part in (("a", rows[:150]), ("b", rows[150:])):
        out.append(spark.createDataFrame(part, SCHEMA), name)
    return out


def same(a, b, rel=1e-12):
    assert a.terms == b.terms and (a.n_obs, a.df_resid, a.n_entities) == (b.n_obs, b.df_resid, b.n_entities)
    assert np.allclose(a.coef, b.coef, rtol=rel * 100, atol=rel) and np.allclose(a.cov, b.cov, rtol=rel * 1e3, atol=rel)
    assert a.ssr == pytest.approx(b.ssr, rel=rel * 100)


def test_fits_equal_those_of_all_rows(spark, store, rows):
    df = spark_frame(spark, rows)
    same(store.ols(), fit_ols(df, "y", XS))
    for key in ("entity", "year"):
        same(store.within(key), fit_within(df, "y", XS, key))
        same(store.between(key), fit_between(df, "y", XS, key))
    same(store.random(), fit_random(df, "y", XS, "entity"))
    robust = [{r.term: r.std_error for r in f.robust_table().collect()} for f in (store.within(), fit_within(df, "y", XS, "entity"))]
    assert robust[0] == pytest.approx(robust[1], rel=1e-9)
    effects = [{r.entity: r.fixed_effect for r in f.fixed_effects().collect()} for f in (store.within(), fit_within(df, "y", XS, "entity"))]
    assert effects[0] == pytest.approx(effects[1], rel=1e-9)


@pytest.mark.parametrize("model", ["within", "between_period"])
def test_folds_equal_those_of_all_rows(spark, store, rows, model):
    df = spark_frame(spark, rows)
    xs = XS if model == "within" else XS[:1]
    if model == "between_period":
        store = MomentStore(spark, f"{store.path}-one", "y", xs, "entity", "year")
        store.append(df, "all")
    wanted = cv_rmse(df, "y", xs, "entity", "year", model=model, min_rows=5).orderBy("fold").collect()
    got = store.cv(model=model, min_rows=5).orderBy("fold").collect()
    assert len(got) == len(wanted) > 3 and any(r.status == "ok" for r in got)
    for a, b in zip(got, wanted):
        assert (a.fold, a.n_train, a.n_test, a.status) == (b.fold, b.n_train, b.n_test, b.status)
        for x, y in zip(a[4:], b[4:]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-8))


def test_large_levels_do_not_cancel(spark, tmp_path):
    """Terms of level 1e8 with a spread of one, some cells of several rows."""
    rows = make(seed=5, shift=1e8, n=20)
    rows += [(e, y, v + 0.2, a, b, c + 0.4) for e, y, v, a, b, c in rows[::2]]
    store = MomentStore(spark, f"{tmp_path}/s", "y", XS, "entity", "year")
    for i in range(3):
        store.append(spark.createDataFrame(rows[i::3], SCHEMA), str(i))
    near = make(seed=5, shift=0.0, n=20)
    near += [(e, y, v + 0.2, a, b, c + 0.4) for e, y, v, a, b, c in near[::2]]
    # The slope of x3 takes the shift of the response along; the others are those without a shift.
    assert store.within().slopes == pytest.approx(fit_within(spark_frame(spark, near), "y", XS, "entity").slopes, rel=1e-6)


def test_appends(spark, store, rows, tmp_path):
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, files in os.walk(store.path) for f in files}
    reopened = MomentStore.open(spark, store.path)
    assert (reopened.y, reopened.xs, reopened.entity, reopened.period) == ("y", XS, "entity", "year")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.append(spark.createDataFrame(rows[:5], SCHEMA), "a")
    more = [("new", 1990 + t, float(t), float(t % 3), float(t * t), 1.0 / (t + 1)) for t in range(6)]
    store.append(spark.createDataFrame(more, SCHEMA), "c")
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, files in os.walk(store.path) for f in files}
    assert before.items() <= after.items()
    same(reopened.within(), fit_within(spark_frame(spark, rows + more), "y", XS, "entity"))
    # The rows themselves are not read by a fit.
    plan = reopened.moments("entity")._jdf.queryExecution().optimizedPlan().toString()
    assert "v0" not in plan
    small = store.compact(f"{tmp_path}/compact")
    keys = [(r.entity, r.period) for r in small.cells().select("entity", "period").collect()]
    assert len(keys) == len(set(keys)) == len({r[:2] for r in rows + more})
    same(MomentStore.open(spark, small.path).within(), reopened.within())
    assert small.cells().agg({"rows": "sum"}).first()[0] == len(rows) + len(more)


def test_empty_and_foreign(spark, tmp_path):
    store = MomentStore(spark, f"{tmp_path}/e", "y", XS, "entity", "year")
    store.append(spark.createDataFrame([], SCHEMA), "none")
    assert MomentStore.open(spark, store.path).xs == XS and store.moments("entity").count() == 0
    with pytest.raises(ValueError, match="no complete rows"):
        store.ols()
    assert store.cv().count() == 0
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no store"):
        MomentStore.open(spark, f"{tmp_path}/other")


def test_hot_key_of_parts(spark, monkeypatch):
    """A key with very many parts, spread by salts, has the moments of its rows."""
    from panelyard.operators import moments as module

    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 50, float(rng.normal()) + 1e6, float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "e string, p int, v0 double, v1 double")
    attach = module.attach_stats
    monkeypatch.setattr(module, "attach_stats", lambda r, s, k, weight: attach(r, s, k, weight, rows_per_task=20, small=False))
    got = {r.e: r for r in merge_moments(df.groupBy("e", "p").agg(*moment_columns(1)), ["e"], 1).collect()}
    for r in df.groupBy("e").agg(*moment_columns(1)).collect():
        assert got[r.e].n == r.n and [got[r.e][c] for c in ("m0", "m1", "c0_0", "c0_1", "c1_1")] == pytest.approx(
            [r[c] for c in ("m0", "m1", "c0_0", "c0_1", "c1_1")], rel=1e-9)
