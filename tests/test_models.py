import math

import numpy as np
import pytest

from panelyard.functions.tails import chi2_tail, f_tail, normal_tail, t_tail
from panelyard.operators.diagnostics import bp_test, bp_test_by, hausman
from panelyard.operators.models import (
    coef_sets, fit_between, fit_ols, fit_random, fit_within, normal_interval, variance_components,
)

XS = ["x1", "x2", "x3"]


def make(seed=0, balanced=False, shift=0.0, effect=1.5, noise=0.5, n=30):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        alpha = rng.normal() * effect
        for t in range(8 if balanced else int(rng.integers(1, 12))):
            x = rng.normal(size=3) + np.array([alpha * 0.3, 0, shift])
            y = 2 + alpha + x @ [0.7, -1.2, 0.4] + rng.normal() * noise * (1 + (i % 3)) + shift
            out.append((f"e{i:02d}", 1990 + t, float(y), *map(float, x)))
    return out


@pytest.fixture(scope="module")
def data():
    return make()


def spark_frame(spark, data):
    return spark.createDataFrame(data, "entity string, year int, y double, x1 double, x2 double, x3 double")


@pytest.fixture()
def df(spark, data):
    bad = [("e00", 2001, None, 1.0, 1.0, 1.0), ("e01", 2002, 1.0, float("nan"), 1.0, 1.0), (None, 2001, 1.0, 1.0, 1.0, 1.0)]
    return spark_frame(spark, data + bad)


def arrays(data):
    ids = np.array([r[0] for r in data])
    y = np.array([r[2] for r in data])
    x = np.array([r[3:] for r in data])
    return ids, y, x


def ols(z, y):
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    return b, e, np.linalg.inv(z.T @ z)


def table(frame):
    return {r["term"]: r for r in frame.collect()}


def test_within_equals_dummy_regression(df, data):
    ids, y, x = arrays(data)
    names = sorted(set(ids))
    dummies = (ids[:, None] == np.array(names)).astype(float)
    b, e, inv = ols(np.hstack([x, dummies]), y)
    dof = len(y) - len(names) - 3
    se = np.sqrt(np.diag(inv)[:3] * (e @ e) / dof)
    fit = fit_within(df, "y", XS, "entity")
    got = table(fit.summary())
    for j, t in enumerate(XS):
        assert got[t]["estimate"] == pytest.approx(b[j])
        assert got[t]["std_error"] == pytest.approx(se[j])
        assert got[t]["p_value"] == pytest.approx(float(t_tail(b[j] / se[j], dof)), abs=1e-12)
    effects = {r["entity"]: r["fixed_effect"] for r in fit.fixed_effects().collect()}
    assert [effects[n] for n in names] == pytest.approx(list(b[3:]))
    stats = fit.statistics().first()
    assert (stats["n_obs"], stats["n_entities"], stats["df_resid"]) == (len(y), len(names), dof)
    assert stats["ssr"] == pytest.approx(e @ e)
    left = {(r["entity"], r["year"]): r["residual"] for r in fit.residuals(["year"]).collect()}
    assert [left[(r[0], r[1])] for r in data] == pytest.approx(list(e), abs=1e-9)

    # Clustered errors by their definition.
    xd = np.vstack([x[ids == n] - x[ids == n].mean(0) for n in names])
    ed = np.concatenate([e[ids == n] for n in names])
    grp = np.concatenate([[n] * (ids == n).sum() for n in names])
    bread = np.linalg.inv(xd.T @ xd)
    meat = sum(np.outer(g, g) for g in (xd[grp == n].T @ ed[grp == n] for n in names))
    robust = table(fit.robust_table())
    assert [robust[t]["std_error"] for t in XS] == pytest.approx(list(np.sqrt(np.diag(bread @ meat @ bread))))

    tidy = table(fit.tidy(0.95))
    assert tidy["x1"]["conf_high"] == pytest.approx(b[0] + 1.959963984540054 * se[0])
    assert coef_sets(fit)["low"]["x1"] == pytest.approx(tidy["x1"]["conf_low"])


def test_within_with_a_large_common_level(spark):
    small, large = make(shift=0.0), make(shift=1e6)
    a = fit_within(spark_frame(spark, small), "y", XS, "entity").coefficients()
    rows = [(i, t, y + 0.4 * 1e6, *x) for (i, t, y, *x) in large]
    b = fit_within(spark_frame(spark, rows), "y", XS, "entity").coefficients()
    assert [b[t] for t in XS] == pytest.approx([a[t] for t in XS], rel=1e-6)


def test_time_effects(df, data):
    years = np.array([r[1] for r in data])
    _, y, x = arrays(data)
    # The row without an entity has a period, so it belongs to the time fit.
    years, y, x = np.append(years, 2001), np.append(y, 1.0), np.vstack([x, [1.0, 1.0, 1.0]])
    dummies = (years[:, None] == np.unique(years)).astype(float)
    b, _, _ = ols(np.hstack([x, dummies]), y)
    got = fit_within(df, "y", XS, "year").coefficients()
    assert [got[t] for t in XS] == pytest.approx(list(b[:3]))


def test_ols_and_between(df, data):
    ids, y, x = arrays(data)
    z = np.hstack([np.ones((len(y) + 1, 1)), np.vstack([x, [1.0, 1.0, 1.0]])])
    yy = np.append(y, 1.0)
    b, e, inv = ols(z, yy)
    se = np.sqrt(np.diag(inv) * (e @ e) / (len(yy) - 4))
    fit = fit_ols(df, "y", XS)
    got = table(fit.summary())
    assert [got[t]["estimate"] for t in ["(Intercept)", *XS]] == pytest.approx(list(b))
    assert [got[t]["std_error"] for t in ["(Intercept)", *XS]] == pytest.approx(list(se))
    stats = fit.statistics().first()
    r2 = 1 - (e @ e) / ((yy - yy.mean()) @ (yy - yy.mean()))
    assert stats["r_squared"] == pytest.approx(r2)
    f = r2 / 3 / ((1 - r2) / (len(yy) - 4))
    assert stats["f_statistic"] == pytest.approx(f)
    assert stats["f_p_value"] == pytest.approx(float(f_tail(f, 3, len(yy) - 4)), abs=1e-12)

    names = sorted(set(ids))
    ym = np.array([y[ids == n].mean() for n in names])
    zm = np.array([[1.0, *x[ids == n].mean(0)] for n in names])
    b, e, inv = ols(zm, ym)
    fit = fit_between(df, "y", XS, "entity")
    got = table(fit.summary())
    assert [got[t]["estimate"] for t in ["(Intercept)", *XS]] == pytest.approx(list(b))
    classic = table(fit.classic_se(50))
    assert classic["x2"]["std_error"] == pytest.approx(math.sqrt(inv[2, 2] * (e @ e) / 48))
    assert table(fit.classic_se())["x2"]["std_error"] == pytest.approx(math.sqrt(inv[2, 2] * (e @ e) / (len(names) - 2)))
    left = {r["entity"]: r["residual"] for r in fit.residuals().collect()}
    assert [left[n] for n in names] == pytest.approx(list(e), abs=1e-9)


def random_effects(data):
    """Variance components and GLS with every matrix written out."""
    ids, y, x = arrays(data)
    names = sorted(set(ids))
    n_rows, n, k = len(y), len(names), x.shape[1]
    sizes = np.array([(ids == m).sum() for m in names])
    xd = np.vstack([x[ids == m] - x[ids == m].mean(0) for m in names])
    yd = np.concatenate([y[ids == m] - y[ids == m].mean() for m in names])
    bw, e, _ = ols(xd, yd)
    sigma_e = e @ e / (n_rows - n - k)
    zbar = np.array([[1.0, *x[ids == m].mean(0)] for m in names])
    ybar = np.array([y[ids == m].mean() for m in names])
    root = np.sqrt(sizes)
    _, eb, _ = ols(zbar * root[:, None], ybar * root)
    p = (zbar * sizes[:, None]).T @ zbar
    tr = np.trace(np.linalg.solve(p, (zbar * (sizes**2)[:, None]).T @ zbar))
    sigma_u = max(0.0, (eb @ eb - (n - k - 1) * sigma_e) / (n_rows - tr))
    zs, ys = [], []
    for m, t in zip(names, sizes):
        theta = 1 - math.sqrt(sigma_e / (sigma_e + t * sigma_u))
        z = np.hstack([np.ones((t, 1)), x[ids == m]])
        zs.append(z - theta * z.mean(0))
        ys.append(y[ids == m] - theta * y[ids == m].mean())
    zs, ys = np.vstack(zs), np.concatenate(ys)
    b, e, inv = ols(zs, ys)
    return b, inv * (e @ e) / (n_rows - k - 1), sigma_e, sigma_u, bw


@pytest.mark.parametrize("options", [{}, {"balanced": True}, {"effect": 0.0, "noise": 2.0}, {"shift": 500.0}])
def test_random_effects(spark, options):
    data = make(seed=5, **options)
    b, cov, sigma_e, sigma_u, _ = random_effects(data)
    fit = fit_random(spark_frame(spark, data), "y", XS, "entity")
    parts = variance_components(fit).first()
    assert parts["sigma2_e"] == pytest.approx(sigma_e)
    assert parts["sigma2_u"] == pytest.approx(sigma_u, abs=1e-7)
    got = table(fit.summary())
    assert [got[t]["estimate"] for t in ["(Intercept)", *XS]] == pytest.approx(list(b), rel=1e-6)
    assert [got[t]["std_error"] for t in ["(Intercept)", *XS]] == pytest.approx(list(np.sqrt(np.diag(cov))), rel=1e-5)
    assert got["x1"]["p_value"] == pytest.approx(float(normal_tail(b[1] / math.sqrt(cov[1, 1]))), abs=1e-9)


def test_hausman(df, data):
    b, cov, *_ = random_effects(data)
    fixed, rand = fit_within(df, "y", XS, "entity"), fit_random(df, "y", XS, "entity")
    d = fixed.slopes - b[1:]
    stat = abs(d @ np.linalg.inv(fixed.cov - cov[1:, 1:]) @ d)
    row = hausman(fixed, rand).first()
    if row["positive_definite"]:
        assert row["statistic"] == pytest.approx(stat, rel=1e-6)
    assert row["df"] == 3
    same = hausman(fixed, fixed).first()   # no variance difference at all
    assert same["positive_definite"] is False and same["statistic"] == pytest.approx(0)


def test_breusch_pagan(df, data):
    ids, y, x = arrays(data)
    z = np.hstack([np.ones((len(y) + 1, 1)), np.vstack([x, [1.0, 1.0, 1.0]])])
    _, e, _ = ols(z, np.append(y, 1.0))
    e2, n = e**2, len(e)
    _, u, _ = ols(z, e2)
    tss = (e2 - e2.mean()) @ (e2 - e2.mean())
    row = bp_test(df, "y", XS).first()
    assert row["statistic"] == pytest.approx(n * (1 - u @ u / tss))
    assert row["p_value"] == pytest.approx(float(chi2_tail(row["statistic"], 3)))
    plain = bp_test(df, "y", XS, studentize=False).first()
    assert plain["statistic"] == pytest.approx(0.5 * (tss - u @ u) / e2.mean() ** 2)


def test_breusch_pagan_per_entity(spark, data):
    constant = [("flat", 1990 + t, float(t), 1.0, 0.0, 0.0) for t in range(5)]
    df = spark_frame(spark, data + constant)
    got = {r["entity"]: r for r in bp_test_by(df, "y", "x1", "entity").collect()}
    assert got["flat"]["statistic"] is None and got["flat"]["p_value"] is None
    ids, y, x = arrays(data)
    for n in sorted(set(ids)):
        yi, xi = y[ids == n], x[ids == n, 0]
        r = got[n]
        assert r["n_obs"] == len(yi)
        if len(yi) < 3:
            assert r["statistic"] is None
            continue
        z = np.column_stack([np.ones(len(yi)), xi])
        _, e, _ = ols(z, yi)
        _, u, _ = ols(z, e**2)
        stat = len(yi) * (1 - u @ u / ((e**2 - (e**2).mean()) @ (e**2 - (e**2).mean())))
        assert r["statistic"] == pytest.approx(stat, abs=1e-8)
        assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(max(stat, 0) / 2)), abs=1e-8)


def test_collinear_terms_are_an_error(spark, data):
    df = spark_frame(spark, [(i, t, y, a, 2 * a, c) for i, t, y, a, b, c in data])
    with pytest.raises(ValueError, match="collinear"):
        fit_within(df, "y", XS, "entity")


def test_normal_interval():
    low, high = normal_interval(0.956268, 0.06368845)
    assert (low, high) == (pytest.approx(0.831441), pytest.approx(1.081095))


def test_tails_against_closed_forms():
    for x in (0.01, 0.5, 1.0, 3.84, 20.0):
        assert float(chi2_tail(x, 1)) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert float(chi2_tail(x, 2)) == pytest.approx(math.exp(-x / 2))
        assert float(chi2_tail(x, 4)) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert float(t_tail(x, 1)) == pytest.approx(1 - 2 * math.atan(x) / math.pi)
        assert float(t_tail(-x, 2)) == pytest.approx(1 - x / math.sqrt(2 + x * x))
        assert float(f_tail(x, 2, 9)) == pytest.approx((1 + 2 * x / 9) ** -4.5)
        assert float(f_tail(x * x, 1, 7)) == pytest.approx(float(t_tail(x, 7)))
    assert math.isnan(float(chi2_tail(float("nan"), 2)))
    assert float(normal_tail(1.959963984540054)) == pytest.approx(0.05)


def test_random_effects_have_a_wald_statistic(spark):
    rng = np.random.default_rng(3)
    data = [(f"e{i}", float(1 + 0.5 * x + a + rng.normal() * 0.3), float(x)) for i in range(30) for a in [rng.normal()] for x in rng.normal(size=6)]
    fit = fit_random(spark.createDataFrame(data, "entity string, y double, x double"), "y", ["x"], "entity")
    row = fit.statistics().first()
    z = fit.slopes[0] / np.sqrt(fit.slope_cov[0, 0])
    assert row["chi2_statistic"] == pytest.approx(z * z) and row["chi2_p_value"] == pytest.approx(float(normal_tail(z)), rel=1e-9)
