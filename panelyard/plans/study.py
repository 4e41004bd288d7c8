"""The two index studies end to end, on tables the caller supplies.

* ratio index: production value per person employed, three drivers, entity effects;
* level index: one measure per area, one driver, group means.

Each takes DataFrames (see the ``*_INPUTS`` lists) and gives back a dict of lazy result
tables; only the fits run jobs. ``index`` and ``index_log`` are the index and its log.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.sizing import kept
from panelyard.session import fit_shuffles
from panelyard.functions.numeric import log1p_of, log1p_square, log_of, log_square, to_double
from panelyard.operators.baseline import baseline_average, baseline_by_group, group_bounds, lag_rows
from panelyard.operators.columns import (
    add_terms, build_level_index, build_ratio_index, columns_at, columns_between, lower_names, minmax, rescale, tag,
)
from panelyard.operators.contrast import (
    factor_table, milestone_means, pct_change_table, report_table, stack_milestones,
)
from panelyard.operators.crossval import cv_report, cv_rmse
from panelyard.operators.diagnostics import bh_adjust, bp_test, bp_test_by, hausman
from panelyard.operators.figures import band_table, cutoff_lines
from panelyard.operators.filters import complete_cases, exclude, keep_groups_with_data, period_between, period_grid
from panelyard.operators.joins import attach_dim, join_panel, resolve_entity, unresolved_names
from panelyard.operators.models import fit_between, fit_ols, fit_random, fit_within, normal_interval
from panelyard.operators.projection import anchor_intercepts, project, scenario_summary
from panelyard.operators.reshape import melt_years
from panelyard.operators.summary import histogram_table, key_figures, normal_density
from panelyard.plans import settings as S

KEYS = ["countrycode", "year"]

RATIO_INPUTS = [
    "production", "employment", "aliases", "regions", "regions_global", "income_group", "development_class",
    "gdppc_wide", "urbanization_wide", "education", "labour_share", "scenarios",
]
LEVEL_INPUTS = [
    "machinery_wide", "regions", "regions_global", "income_group", "development_class", "gdppc_wide", "scenarios",
]

Tables = Mapping[str, DataFrame]


# --- inputs ----------------------------------------------------------------------------

def production(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    df = lower_names(raw).select("area", "year", to_double("value").alias("value"))
    return resolve_entity(df, "area", aliases).drop("area")


def employment(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Totals over both sexes, in persons; areas without a code are dropped."""
    df = lower_names(raw).filter(F.col("sex") == "Total").select(
        "area", "year", "sex", to_double("value").alias("employed")
    )
    df = resolve_entity(rescale(df, "employed", 1000), "area", aliases).drop("area")
    return complete_cases(df, ["countrycode"])


def unresolved(t: Tables) -> DataFrame:
    """Area names without a code, with their rows in each source; the panel leaves them out."""
    sources = {"production": lower_names(t["production"]), "employment": lower_names(t["employment"]).filter(F.col("sex") == "Total")}
    parts = [tag(unresolved_names(df.select("area"), "area", t["aliases"]), source=name) for name, df in sources.items()]
    return parts[0].unionByName(parts[1])


def gdppc_history(wide: DataFrame) -> DataFrame:
    wide = lower_names(wide)
    cols = columns_between(wide, "x1960", "x2019")
    long = melt_years(wide, ["`country.code`"], cols, "gdppc")
    long = long.withColumnRenamed("country.code", "countrycode")
    long = period_between(long, "year", 1991, 2020).withColumn("gdppc_log", log_of("gdppc"))
    return minmax(long, "gdppc", *S.NORMAL_BOUNDS["gdppc"])


def urbanization_history(wide: DataFrame) -> DataFrame:
    cols = columns_at(wide, 2, 142)
    long = melt_years(wide, ["country or area"], cols, "urbanization").withColumnRenamed("country or area", "countrycode")
    long = period_between(long, "year", 1991, 2008).withColumn("urbanization_log", log_of("urbanization"))
    return minmax(long, "urbanization", *S.NORMAL_BOUNDS["urbanization"])


def education_history(raw: DataFrame) -> DataFrame:
    df = raw.select("countrycode", "year", F.col("`post.secondary`").alias("education"))
    return lag_rows(period_between(df, "year", 1970, 2015), "countrycode", "year", "education", 5)


def labour_share(raw: DataFrame) -> DataFrame:
    df = lower_names(raw).drop("entity").withColumnRenamed("code", "countrycode")
    return minmax(df, "share_employed_agri", *S.NORMAL_BOUNDS["share_employed_agri"])


def scenario_drivers(raw: DataFrame, drivers: list[str], left_out: list[str] = ()) -> DataFrame:
    df = raw.withColumnRenamed("postsec", "education").select("countrycode", "year", "scenario", *drivers)
    df = period_grid(df, "year", *S.SCENARIO_GRID)
    return exclude(df, "countrycode", left_out) if left_out else df


# --- panels ----------------------------------------------------------------------------

def ratio_panel(value: DataFrame, employed: DataFrame) -> DataFrame:
    """Complete production / employment rows with the index; one entity is left out."""
    rows = complete_cases(join_panel(value, employed, KEYS))
    rows = exclude(build_ratio_index(rows, "value", "employed"), "countrycode", [S.RATIO_DROPPED])
    return tag(rows, scenario="Baseline")


def level_panel(wide: DataFrame, first: int = 6, last: int = 50) -> DataFrame:
    """Year columns at positions ``first`` to ``last`` melted, with the index."""
    long = melt_years(wide, ["Country Code"], columns_at(wide, first, last), "tractors")
    return build_level_index(long.withColumnRenamed("Country Code", "countrycode"), "tractors")


def ratio_master(panel: DataFrame, t: Tables) -> DataFrame:
    out = panel
    for part in (
        gdppc_history(t["gdppc_wide"]), urbanization_history(t["urbanization_wide"]),
        education_history(t["education"]), labour_share(t["labour_share"]),
    ):
        out = join_panel(out, part, KEYS)
    out = attach_dim(out, t["regions_global"], "countrycode", fanout=True)
    out = tag(out, scenario="Baseline").drop("value", "sex", "employed")
    return add_terms(out, {
        "log_gdppc": log_of("gdppc"),
        "log_urbanization2": log_square("urbanization"),
        "log1p_education2": log1p_square("education_lag"),
    })


def level_master(panel: DataFrame, t: Tables) -> DataFrame:
    gdppc = gdppc_history(t["gdppc_wide"]).select(*KEYS, "gdppc")
    out = attach_dim(join_panel(panel, gdppc, KEYS), t["regions"], "countrycode")
    return add_terms(tag(out, scenario="Baseline"), {"log_gdppc": log_of("gdppc")})


# --- shared steps ----------------------------------------------------------------------

def _summaries(
    proj: DataFrame, panel: DataFrame, t: Tables,
    class_years: tuple[int, int], income_years: tuple[int, int] | None, known_regions: bool,
) -> dict[str, DataFrame]:
    """Scenario summaries and baselines by region, income group and development class.
    ``known_regions`` drops entities without a region from the baselines."""
    by_region = proj.join(t["regions"], "countrycode", "left")
    known = by_region.filter("region IS NOT NULL")
    out = {"summary": scenario_summary(by_region, "region", collapse=True)}
    base = baseline_average(
        attach_dim(panel, t["regions"], "countrycode"), "countrycode", "year",
        {"index_log": "average"}, S.BASELINE_YEARS, S.BASELINE_AT,
    )
    if known_regions:
        base = base.filter("region IS NOT NULL")
    out["summary_baseline"] = tag(baseline_by_group(base, "region", "index_log"), scenario="Baseline")
    for name, table, group in (
        ("income", "income_group", "income_group"), ("class", "development_class", "classification"),
    ):
        dim = t[table].select("countrycode", group)
        out[f"{name}_summary"] = scenario_summary(
            attach_dim(known, dim, "countrycode"), group, levels=False, collapse=True
        )
        out[f"{name}_summary_baseline"] = baseline_by_group(
            attach_dim(base, dim, "countrycode"), group, "index_log",
            period="year", years=class_years, drop_null_group=True,
        )
    rows = attach_dim(panel, t["income_group"], "countrycode")
    income = baseline_by_group(rows, "income_group", "index_log", period="year", years=income_years)
    out["income_baseline"] = income
    out["income_bounds"] = group_bounds(income, "income_group", "baseline")
    return out


def _bands(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Chart tables of the collapsed summaries."""
    after = S.LAST_OBSERVED
    return {
        "band": band_table(out["summary"], "region", after=after),
        "band_main": band_table(out["summary"], "region", after=after, leave_out=S.HIDDEN_SCENARIOS),
        "band_level": band_table(out["summary"], "region", after=after, scale="level"),
        "band_one": band_table(out["summary"], "region", only=["SSP2"]),
        "band_income": band_table(out["income_summary"], "income_group", after=after),
        "band_class": band_table(out["class_summary"], "classification", after=after),
    }


def _contrast(proj: DataFrame, base: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """Milestone means per region and scenario against the region's baseline."""
    years = list(S.MILESTONES)
    stacked = stack_milestones(
        tag(attach_dim(proj, t["regions_global"], "countrycode", fanout=True), source="projection"),
        tag(base, source="baseline"), "year", (S.BASELINE_AT, *years),
    )
    means = milestone_means(stacked, ["region", "scenario"], "year", "proj_fit", years)
    pct = pct_change_table(means, base, "region", "average_2005", years)
    factor = factor_table(means, base, "region", "average_2005", years)
    return {
        "pct_change": pct,
        "factor": factor,
        "pct_report": report_table(pct, S.REPORT_SCENARIOS, ["average_2005", *[f"diff_{y}" for y in years]]),
        "factor_report": report_table(
            factor, S.REPORT_SCENARIOS, ["average_2005", *[f"factor_diff_{y}" for y in years]]
        ),
    }


# --- studies ---------------------------------------------------------------------------

def ratio_study(t: Tables, coefs=S.RATIO_COEFS, anchor: int = 2008) -> dict[str, DataFrame]:
    """Index, diagnostics, projection, summaries, contrast tables and out-of-sample error.

    Projection uses the published coefficients on log(gdppc), log(urbanization) and
    log1p(education), as in the study; the model is fitted on the squared terms.
    """
    t = {name: fit_shuffles(table) for name, table in t.items()}
    panel = kept(ratio_panel(production(t["production"], t["aliases"]), employment(t["employment"], t["aliases"])))
    master = kept(ratio_master(panel, t))
    xs = ["log_gdppc", "log_urbanization2", "log1p_education2"]
    fixed = fit_within(master, "index_log", xs, "countrycode")
    random = fit_random(master, "index_log", xs, "countrycode", fixed.moments)

    def terms():
        return {
            "gdppc": log_of("gdppc"), "urbanization": log_of("urbanization"), "education": log1p_of("education"),
        }

    anchors = anchor_intercepts(master, "countrycode", "year", "index_log", terms(), coefs, anchor)
    drivers = scenario_drivers(t["scenarios"], ["education", "gdppc", "urbanization"], S.RATIO_NOT_PROJECTED)
    proj = kept(project(drivers, anchors, "countrycode", terms(), coefs))

    out = {"index": panel, "master": master, "projection": proj, "intercepts": anchors, "unresolved": unresolved(t)}
    out["baseline_map"] = baseline_average(
        panel, "countrycode", "year",
        {"index_log": "average", "value": "average_value", "employed": "average_employed"},
        S.BASELINE_YEARS, S.BASELINE_AT,
    )
    out["key_figures"] = key_figures(out["baseline_map"], "index_log", "countrycode")
    out |= _distribution(panel)
    out |= {
        "coefficients": fixed.tidy(), "fit": fixed.statistics(), "robust": fixed.robust_table(),
        "fixed_effects": fixed.fixed_effects(), "random": random.summary(), "hausman": hausman(fixed, random),
        "breusch_pagan": bp_test(master, "index_log", xs),
        "urbanization_labour": fit_ols(master, "urbanization", ["share_employed_agri"]).summary(),
    }
    # The income baseline of this study covers all years.
    out |= _summaries(proj, panel, t, (2000, 2005), None, known_regions=False)
    out |= _bands(out)
    regions = t["regions"].select("region").filter("region IS NOT NULL").distinct()
    out["cutoffs"] = cutoff_lines(regions, S.RATIO_CUTOFFS, S.RATIO_HIDDEN)
    base = baseline_average(
        attach_dim(panel, t["regions_global"], "countrycode", fanout=True), "region", "year",
        {"index_log": "average_2005"}, S.BASELINE_YEARS, S.BASELINE_AT,
    )
    out |= _contrast(proj, base, t)
    out["cv"] = cv_rmse(master, "index_log", xs, "countrycode", "year")
    out["cv_report"] = cv_report(out["cv"])
    return out


def level_study(
    t: Tables, slope: float = S.LEVEL_SLOPE, std_error: float = S.LEVEL_STD_ERROR, anchor: int = 2005
) -> dict[str, DataFrame]:
    """The level index: group-mean regression on log(gdppc), per-entity tests, projection and tables."""
    t = {name: fit_shuffles(table) for name, table in t.items()}
    panel = kept(level_panel(t["machinery_wide"]))
    master = kept(level_master(panel, t))
    fit = fit_between(master, "index_log", ["log_gdppc"], "countrycode")
    low, high = normal_interval(slope, std_error)
    coefs = {"fit": {"gdppc": slope}, "low": {"gdppc": low}, "high": {"gdppc": high}}

    def terms():
        return {"gdppc": log_of("gdppc")}

    anchors = anchor_intercepts(master, "countrycode", "year", "index_log", terms(), coefs, anchor)
    proj = kept(project(scenario_drivers(t["scenarios"], ["gdppc"]), anchors, "countrycode", terms(), coefs))

    out = {"index": panel, "master": master, "projection": proj, "intercepts": anchors}
    out["baseline_map"] = baseline_average(
        panel, "countrycode", "year", {"index_log": "average"}, S.BASELINE_YEARS, S.BASELINE_AT
    )
    out["key_figures"] = key_figures(out["baseline_map"], "index_log", "countrycode")
    out |= _distribution(panel)
    usable = keep_groups_with_data(master, ["countrycode"], ["index_log", "log_gdppc"])
    by_entity = bp_test_by(usable, "index_log", "log_gdppc", "countrycode")
    out |= {
        "coefficients": fit.tidy(), "fit": fit.statistics(),
        # Counts every entity of the panel, with or without data.
        "classic_errors": fit.classic_se(master.agg(F.count_distinct("countrycode")).first()[0]),
        "level_response": fit_between(master, "index", ["log_gdppc"], "countrycode").summary(),
        "heteroskedasticity": bp_test(master, "index_log", ["log_gdppc"], studentize=False),
        "entity_tests": bh_adjust(by_entity, "p_value"),
    }
    out |= _summaries(proj, panel, t, S.BASELINE_YEARS, S.BASELINE_YEARS, known_regions=True)
    out |= _bands(out)
    regions = t["regions"].select("region").filter("region IS NOT NULL").distinct()
    out["cutoffs"] = cutoff_lines(regions, S.LEVEL_CUTOFFS, S.LEVEL_HIDDEN)

    # One row per entity at the reference year; its contrast baseline is that year's value.
    at_reference = baseline_average(panel, "countrycode", "year", {"index_log": "average"}, (1996, 2015), S.BASELINE_AT)
    years = list(S.MILESTONES)
    stacked = stack_milestones(proj, at_reference, "year", (S.BASELINE_AT, *years))
    out["entity_pct_change"] = pct_change_table(
        milestone_means(stacked, ["countrycode"], "year", "proj_fit", years),
        at_reference, "countrycode", "index_log", years,
    )
    base = baseline_average(
        attach_dim(at_reference, t["regions_global"], "countrycode", fanout=True), "region", "year",
        {"index_log": "average_2005"}, S.BASELINE_YEARS, S.BASELINE_AT,
    )
    out |= _contrast(proj, base, t)
    out["cv"] = cv_rmse(
        master, "index_log", ["log_gdppc"], "countrycode", "year", model="between_period", min_rows=1
    )
    out["cv_report"] = cv_report(out["cv"])
    return out


def _distribution(panel: DataFrame) -> dict[str, DataFrame]:
    return {"histogram": histogram_table(panel, "index_log"), "normal_curve": normal_density(panel, "index_log")}


__all__ = ["LEVEL_INPUTS", "RATIO_INPUTS", "level_study", "ratio_study"]
