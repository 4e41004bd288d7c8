"""Both studies on small invented tables, against the same steps in pandas."""

import numpy as np
import pandas as pd
import pytest

from panelyard.plans import settings as S
from panelyard.plans.study import LEVEL_INPUTS, RATIO_INPUTS, level_study, ratio_study

CODES = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG", "HHH", "ARG", "TUR"]
REGION = dict(zip(CODES, ["Europe", "Europe", "South Asia", "South Asia", "Central Asia", "Central Asia",
                          "North America", None, "Europe", "Europe"]))
YEARS = list(range(1991, 2013))


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(11)
    f = {}
    level = {c: rng.uniform(1, 9) for c in CODES}
    grid = [(c, y) for c in CODES for y in YEARS]
    f["production"] = pd.DataFrame(
        [(f"Land of {c}", y, "n/a" if rng.uniform() < 0.05 else str(round(level[c] * 1e6 * rng.uniform(0.8, 1.2), 3))) for c, y in grid]
        + [("Nowhere", 2000, "5")], columns=["Area", "Year", "Value"])
    f["employment"] = pd.DataFrame(
        [(f"land of {c.lower()}", y, sex, str(round(rng.uniform(50, 90), 3))) for c, y in grid for sex in ("Total", "Male")
         if rng.uniform() > 0.03] + [("Nowhere", 2000, "Total", "5")], columns=["Area", "Year", "Sex", "Value"])
    f["aliases"] = pd.DataFrame([(f"Land of {c}", c) for c in CODES], columns=["alias", "countrycode"])
    f["regions"] = pd.DataFrame([(c, r) for c, r in REGION.items() if r], columns=["countrycode", "region"])
    f["regions_global"] = pd.concat([f["regions"], pd.DataFrame([(c, "World") for c in CODES], columns=["countrycode", "region"])])
    groups = ["High income", "Low income", "Lower middle income", "Upper middle income"]
    f["income_group"] = pd.DataFrame([(c, groups[i % 4]) for i, c in enumerate(CODES) if c != "GGG"], columns=["countrycode", "income_group"])
    f["development_class"] = pd.DataFrame([(c, ["Developed", "Developing"][i % 2]) for i, c in enumerate(CODES)], columns=["countrycode", "classification"])
    gdp = {(c, y): level[c] * 1000 * np.exp(rng.normal() * 0.2 + (y - 1991) * 0.01) for c in CODES for y in range(1960, 2020)}
    f["gdppc_wide"] = pd.DataFrame([[c, f"name {c}", *[gdp[c, y] if rng.uniform() > 0.02 else None for y in range(1960, 2020)]] for c in CODES],
                                   columns=["Country.Code", "Country.Name", *[f"X{y}" for y in range(1960, 2020)]])
    f["urbanization_wide"] = pd.DataFrame([[c, *[float(rng.uniform(20, 90)) for _ in range(141)]] for c in CODES],
                                          columns=["country or area", *[str(y) for y in range(1950, 2091)]])
    f["education"] = pd.DataFrame([(c, y, float(rng.uniform(0.05, 0.6))) for c in CODES for y in range(1970, 2016) if not (c == "CCC" and y == 1990)],
                                  columns=["countrycode", "year", "post.secondary"])
    f["labour_share"] = pd.DataFrame([(f"Land {c}", c, y, float(rng.uniform(1, 60))) for c, y in grid], columns=["Entity", "Code", "Year", "share_employed_agri"])
    f["scenarios"] = pd.DataFrame(
        [(c, y, s, float(rng.uniform(0.1, 0.8)), float(rng.uniform(2e3, 6e4)), float(rng.uniform(30, 95)), "x")
         for c in CODES for y in range(2015, 2101, 5) for s in ("SSP1", "SSP2", "SSP3", "SSP4", "SSP5")],
        columns=["countrycode", "year", "scenario", "postsec", "gdppc", "urbanization", "other"])
    tr = [[f"n{c}", c, "i", "ic", "s", *[None if rng.uniform() < 0.1 else (0.0 if c == "FFF" and y == 1970 else float(level[c] * rng.uniform(1, 30)))
                                        for y in range(1966, 2011)]] for c in CODES]
    tr.append(["nZZZ", "ZZZ", "i", "ic", "s", *[None] * 45])
    f["machinery_wide"] = pd.DataFrame(tr, columns=["Country Name", "Country Code", "Indicator", "Indicator Code", "Source", *[str(y) for y in range(1966, 2011)]])
    return f


def to_spark(spark, frames, names):
    out = {}
    for n in names:
        pdf = frames[n]
        kinds = ["double" if pdf[c].dtype.kind == "f" else "int" if pdf[c].dtype.kind == "i" else "string" for c in pdf.columns]
        ddl = ", ".join(f"`{c}` {k}" for c, k in zip(pdf.columns, kinds))
        records = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.astype(object).values.tolist()]
        out[n] = spark.createDataFrame(records, ddl)
    return out


def as_pandas(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def same(got, want, keys, cols):
    got = got.sort_values(keys).reset_index(drop=True)
    want = want.sort_values(keys).reset_index(drop=True)
    assert len(got) == len(want)
    for k in keys:
        assert got[k].where(got[k].notna(), None).tolist() == want[k].where(want[k].notna(), None).tolist(), k
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def grouped(df, keys, value, name):
    return df.groupby(keys, dropna=False)[value].transform("mean").rename(name)


def pandas_gdp(f):
    g = f["gdppc_wide"].melt(id_vars=["Country.Code"], value_vars=[f"X{y}" for y in range(1960, 2020)], var_name="year", value_name="gdppc")
    g["year"] = g["year"].str[1:].astype(int)
    return g[g.year.between(1991, 2020)].rename(columns={"Country.Code": "countrycode"})


def contrast(proj, base, f):
    """Region means at the milestones against the base, percent changes and factors."""
    p = proj.merge(f["regions_global"], on="countrycode", how="left")
    stacked = pd.concat([p, base])[["scenario", "region", "year", "proj_fit"]]
    stacked = stacked[stacked.year.isin([2005, 2035, 2050, 2075, 2100])]
    means = stacked[["region", "scenario"]].drop_duplicates()
    for y in (2035, 2050, 2075, 2100):
        m = stacked[stacked.year == y].groupby(["region", "scenario"], dropna=False).proj_fit.mean().rename(f"mean_proj_{y}").reset_index()
        means = means.merge(m, on=["region", "scenario"], how="left")
    means = means.merge(base[["region", "average_2005"]].drop_duplicates(), on="region", how="left")
    for y in (2035, 2050, 2075, 2100):
        means[f"diff_{y}"] = (means[f"mean_proj_{y}"] - means.average_2005) / means.average_2005 * 100
        means[f"factor_diff_{y}"] = means[f"mean_proj_{y}"] / means.average_2005
    return means


def test_ratio_study(spark, frames):
    f = frames
    out = ratio_study(to_spark(spark, f, RATIO_INPUTS))

    assert sorted(tuple(r) for r in out["unresolved"].select("area", "rows", "source").collect()) == [
        ("Nowhere", 1, "employment"), ("Nowhere", 1, "production"),
    ]
    code = {f"land of {c.lower()}": c for c in CODES}
    v = f["production"].rename(columns=str.lower)
    v = v.assign(countrycode=v.area.str.lower().map(code), value=pd.to_numeric(v.value, errors="coerce")).drop(columns="area")
    e = f["employment"].rename(columns=str.lower)
    e = e[e.sex == "Total"].assign(countrycode=lambda d: d.area.str.lower().map(code), employed=lambda d: pd.to_numeric(d.value) * 1000)
    e = e.dropna(subset=["countrycode"])[["countrycode", "year", "sex", "employed"]]
    panel = v.merge(e, on=["countrycode", "year"], how="left").dropna()
    panel = panel[panel.countrycode != "ARG"].assign(index_log=lambda d: np.log(d.value / d.employed))
    same(as_pandas(out["index"], "countrycode", "year"), panel, ["countrycode", "year"], ["value", "employed", "index_log"])

    window = panel[panel.year.between(2000, 2010)].copy()
    window["average"] = grouped(window, ["countrycode"], "index_log", "average")
    dat = window[window.year == 2005]
    same(as_pandas(out["baseline_map"], "countrycode"), dat, ["countrycode"], ["index_log", "average"])

    ed = f["education"].sort_values(["countrycode", "year"]).rename(columns={"post.secondary": "education"})
    ed["education_lag"] = ed.groupby("countrycode").education.shift(5)
    ur = f["urbanization_wide"].melt(id_vars=["country or area"], var_name="year", value_name="urbanization")
    ur = ur.assign(year=ur.year.astype(int)).rename(columns={"country or area": "countrycode"})
    ur = ur[ur.year.between(1991, 2008)]
    sh = f["labour_share"].rename(columns=str.lower).rename(columns={"code": "countrycode"}).drop(columns="entity")
    master = panel
    for part in (pandas_gdp(f), ur, ed, sh):
        master = master.merge(part, on=["countrycode", "year"], how="left")
    master = master.merge(f["regions_global"], on="countrycode", how="left")
    same(as_pandas(out["master"], "countrycode", "year", "region"), master, ["countrycode", "year", "region"],
         ["gdppc", "urbanization", "education_lag", "share_employed_agri"])

    m = master.assign(a=np.log(master.gdppc), b=np.log(master.urbanization**2), c=np.log1p(master.education_lag**2)).dropna(subset=["a", "b", "c"])
    z = m[["a", "b", "c"]] - m.groupby("countrycode")[["a", "b", "c"]].transform("mean")
    y = m.index_log - m.groupby("countrycode").index_log.transform("mean")
    slopes = np.linalg.lstsq(z.to_numpy(), y.to_numpy(), rcond=None)[0]
    got = {r["term"]: r["estimate"] for r in out["coefficients"].collect()}
    assert list(got.values()) == pytest.approx(list(slopes))

    at = master[master.year == 2008]
    inter = pd.DataFrame({"countrycode": at.countrycode})
    for s, b in S.RATIO_COEFS.items():
        inter[s] = at.index_log - b["gdppc"] * np.log(at.gdppc) - b["urbanization"] * np.log(at.urbanization) - b["education"] * np.log1p(at.education)
    sc = f["scenarios"].rename(columns={"postsec": "education"}).drop(columns="other")
    sc = sc[sc.year.isin(range(2020, 2101, 5)) & ~sc.countrycode.isin(S.RATIO_NOT_PROJECTED)]
    proj = sc.merge(inter, on="countrycode", how="left")
    for s, b in S.RATIO_COEFS.items():
        proj[f"proj_{s}"] = proj[s] + b["gdppc"] * np.log(proj.gdppc) + b["urbanization"] * np.log(proj.urbanization) + b["education"] * np.log1p(proj.education)
    same(as_pandas(out["projection"], "countrycode"), proj, ["countrycode", "scenario", "year", "gdppc"], ["proj_fit", "proj_low", "proj_high"])

    s = proj.merge(f["regions"], on="countrycode", how="left").dropna(subset=["region"])
    want = s.groupby(["region", "scenario", "year"]).agg(index_fit=("proj_fit", "mean"), index_upr=("proj_high", "mean"), index_lwr=("proj_low", "mean")).reset_index()
    want["exp_index_fit"] = s.assign(x=np.exp(s.proj_fit)).groupby(["region", "scenario", "year"]).x.mean().to_numpy()
    same(out["summary"].toPandas(), want, ["region", "scenario", "year"], ["index_fit", "index_upr", "index_lwr", "exp_index_fit"])
    inc = s.merge(f["income_group"], on="countrycode", how="left").dropna(subset=["income_group"])
    want = inc.groupby(["income_group", "scenario", "year"]).proj_fit.mean().rename("index_fit").reset_index()
    same(out["income_summary"].toPandas(), want, ["income_group", "scenario", "year"], ["index_fit"])

    # The study's baseline means include entities without a region, as a group of their own.
    base = dat.merge(f["regions"], on="countrycode", how="left")
    base["baseline"] = grouped(base, ["region"], "index_log", "baseline")
    same(out["summary_baseline"].toPandas(), base, ["countrycode", "region"], ["baseline"])
    bounds = panel.merge(f["income_group"], on="countrycode", how="left").groupby("income_group").index_log.mean().rename("ymin").reset_index()
    same(out["income_bounds"].toPandas(), bounds, ["income_group"], ["ymin"])

    g = window.merge(f["regions_global"], on="countrycode", how="left")
    g["average_2005"] = grouped(g, ["region"], "index_log", "average_2005")
    g = g[g.year == 2005].assign(scenario="Baseline")
    table = contrast(proj, g, f)
    cols = [f"diff_{y}" for y in S.MILESTONES]
    same(out["pct_change"].toPandas(), table, ["region", "scenario"], ["average_2005", *cols])
    same(out["factor"].toPandas(), table, ["region", "scenario"], [f"factor_diff_{y}" for y in S.MILESTONES])
    report = out["pct_report"].toPandas()
    assert set(report.scenario) == {"SSP1", "SSP2", "SSP3"}
    assert out["cutoffs"].count() == 4 * 3 - 3 - 2   # four regions; Europe and North America keep one line

    assert out["cv_report"].first()["verdict"] in ("train_better", "test_better", "equal", None)
    for name in ("robust", "random", "hausman", "breusch_pagan", "urbanization_labour", "band_income"):
        assert out[name].count() > 0, name
    assert {"histogram", "normal_curve", "fixed_effects", "band_class", "factor_report", "key_figures"} <= set(out)


def test_level_study(spark, frames):
    f = frames
    out = level_study(to_spark(spark, f, LEVEL_INPUTS))
    w = f["machinery_wide"]
    panel = w.melt(id_vars=["Country Code"], value_vars=list(w.columns[5:50]), var_name="year", value_name="tractors")
    panel = panel.assign(year=panel.year.astype(int)).rename(columns={"Country Code": "countrycode"})
    panel["tractors"] = panel.tractors.astype(float)
    panel["index_log"] = np.log(panel.tractors.where(panel.tractors > 0))
    same(out["index"].toPandas(), panel, ["countrycode", "year"], ["tractors", "index_log"])

    master = panel.merge(pandas_gdp(f), on=["countrycode", "year"], how="left")
    m = master.assign(x=np.log(master.gdppc)).dropna(subset=["index_log", "x"])
    means = m.groupby("countrycode")[["index_log", "x"]].mean()
    z = np.column_stack([np.ones(len(means)), means.x])
    b, rss, *_ = np.linalg.lstsq(z, means.index_log.to_numpy(), rcond=None)
    got = {r["term"]: r["estimate"] for r in out["coefficients"].collect()}
    assert (got["(Intercept)"], got["log_gdppc"]) == (pytest.approx(b[0]), pytest.approx(b[1]))
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * rss[0] / (11 - 2))   # eleven codes, one without any data
    classic = {r["term"]: r["std_error"] for r in out["classic_errors"].collect()}
    assert classic["log_gdppc"] == pytest.approx(se[1])

    at = master[master.year == 2005]
    inter = pd.DataFrame({"countrycode": at.countrycode, "fit": at.index_log - S.LEVEL_SLOPE * np.log(at.gdppc)})
    sc = f["scenarios"]
    sc = sc[sc.year.isin(range(2020, 2101, 5))][["countrycode", "year", "scenario", "gdppc"]]
    proj = sc.merge(inter, on="countrycode", how="left")
    proj["proj_fit"] = proj.fit + S.LEVEL_SLOPE * np.log(proj.gdppc)
    same(out["projection"].toPandas(), proj, ["countrycode", "scenario", "year"], ["proj_fit"])

    one = panel[(panel.year == 2005)]
    e = proj[proj.year == 2050].groupby("countrycode").proj_fit.mean().rename("m").reset_index()
    want = one.merge(e, on="countrycode", how="left")
    want["diff_2050"] = (want.m - want.index_log) / want.index_log * 100
    same(out["entity_pct_change"].toPandas(), want, ["countrycode"], ["diff_2050"])

    g = one.merge(f["regions_global"], on="countrycode", how="left")
    g["average_2005"] = grouped(g, ["region"], "index_log", "average_2005")
    table = contrast(proj, g.assign(scenario=None), f)
    same(out["pct_change"].toPandas(), table, ["region", "scenario"], [f"diff_{y}" for y in S.MILESTONES])

    tests = {r["countrycode"]: r for r in out["entity_tests"].collect()}
    assert "ZZZ" not in tests and len(tests) == 10
    assert all(r["p_adjusted"] >= r["p_value"] * (1 - 1e-12) for r in tests.values() if r["p_value"] is not None)
    assert out["summary_baseline"].filter("region IS NULL").count() == 0
    assert out["cutoffs"].count() == 4 * 3 - 2   # Central Asia and North America lose one line each
    for name in ("heteroskedasticity", "cv_report", "band_main"):
        assert out[name].count() > 0, name
