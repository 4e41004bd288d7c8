import math
import random

import pytest
from pyspark.sql import functions as F

from panel_rows import rows
from panelyard.functions.numeric import log_of
from panelyard.operators.contrast import (
    factor_table, milestone_means, pct_change_table, report_table, stack_milestones,
)
from panelyard.operators.figures import band_table
from panelyard.operators.projection import anchor_intercepts, coef_table, project, scenario_summary

COEFS = {"fit": {"g": 0.5}, "low": {"g": 0.4}, "high": {"g": 0.6}}


@pytest.fixture()
def proj(spark):
    rng = random.Random(1)
    hist = spark.createDataFrame(
        [("A", 2005, 1.0, 10.0), ("A", 2006, 9.0, 10.0), ("B", 2005, 2.0, 20.0), ("C", 2005, None, 5.0)],
        "code string, year int, y double, gdp double",
    )
    anchors = anchor_intercepts(hist, "code", "year", "y", {"g": log_of("gdp")}, COEFS, 2005)
    drivers = spark.createDataFrame(
        [(c, s, y, rng.uniform(10, 50)) for c in "ABCD" for s in ("S1", "S2") for y in (2015, 2035, 2050)],
        "code string, scenario string, year int, gdp double",
    )
    return project(drivers, anchors, "code", {"g": log_of("gdp")}, COEFS)


def test_projection_goes_through_the_anchor(spark, proj):
    for r in proj.collect():
        if r["code"] == "A":
            for name, b in (("fit", 0.5), ("low", 0.4), ("high", 0.6)):
                assert r[f"proj_{name}"] == pytest.approx(1.0 + b * math.log(r["gdp"] / 10))
        if r["code"] in "CD":   # no observed value, no anchor row
            assert r["proj_fit"] is None
    assert proj.count() == 24
    assert coef_table(spark, COEFS).count() == 3
    with pytest.raises(ValueError, match="no expression"):
        project(proj, proj, "code", {}, COEFS)


def test_projection_from_slopes_alone(spark):
    drivers = spark.createDataFrame([("A", 8.0)], "code string, gdp double")
    bare = project(drivers, None, "code", {"g": log_of("gdp")}, COEFS)
    assert bare.first()["proj_fit"] == pytest.approx(0.5 * math.log(8))
    level = project(drivers, None, "code", {"g": log_of("gdp")}, COEFS, level=True)
    assert level.first()["proj_high"] == pytest.approx(8**0.6)


def groups(spark):
    return spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", None)], "code string, region string")


def test_collapsed_summary_is_the_distinct_kept_one(spark, proj):
    data = proj.join(groups(spark), "code", "left")
    cols = ["region", "scenario", "year", "index_fit", "index_upr", "index_lwr", "exp_index_fit"]
    kept = scenario_summary(data, "region")
    assert kept.count() == 18
    a = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in kept.select(*cols).distinct().collect() if r[3] is not None)
    flat = scenario_summary(data, "region", collapse=True)
    b = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in flat.select(*cols).collect() if r[3] is not None)
    assert a == b and len(b) == 6
    for r in flat.filter("region = 'x'").collect():
        assert r["index_lwr"] <= r["index_fit"] <= r["index_upr"]   # drivers only grow
        assert r["exp_index_fit"] >= math.exp(r["index_fit"])
    band = band_table(flat, "region", after=2019, leave_out=["S2"])
    assert {(r["scenario"], r["year"]) for r in band.collect()} == {("S1", 2035), ("S1", 2050)}
    level = band_table(flat, "region", only=["S2"], scale="level").filter("region = 'x' AND year = 2050").first()
    same = flat.filter("region = 'x' AND year = 2050 AND scenario = 'S2'").first()
    assert level["fit"] == same["exp_index_fit"]


def test_contrast_tables(spark, proj):
    years = [2035, 2050]
    base = spark.createDataFrame([("x", "A", 2005, 1.5), ("x", "B", 2005, 1.5), ("y", "C", 2005, 0.0)], "region string, code string, year int, average double")
    stacked = stack_milestones(proj.join(groups(spark), "code", "left"), base, "year", (2005, *years))
    assert stacked.count() == 16 + 3
    means = milestone_means(stacked, ["region", "scenario"], "year", "proj_fit", years)
    pct = {(r["region"], r["scenario"]): r for r in pct_change_table(means, base, "region", "average", years).collect()}
    fac = {(r["region"], r["scenario"]): r for r in factor_table(means, base, "region", "average", years).collect()}
    assert set(pct) == set(fac) == {(g, s) for g in ("x", "y", None) for s in ("S1", "S2")} | {("x", None), ("y", None)}
    for key, r in pct.items():
        f = fac[key]
        for y in years:
            if key[0] == "x" and key[1]:
                assert r[f"diff_{y}"] == pytest.approx((f[f"factor_diff_{y}"] - 1) * 100)
            else:
                assert r[f"diff_{y}"] is None and f[f"factor_diff_{y}"] is None
    report = report_table(pct_change_table(means, base, "region", "average", years), ["S1"], ["average", "diff_2050"])
    assert report.columns == ["average", "diff_2050", "region", "scenario"]
    assert {r["scenario"] for r in report.collect()} == {"S1"}
    assert report.filter(F.col("diff_2050") != F.round("diff_2050", 2)).count() == 0
    assert len(rows(report)) == 3
