"""Registered queries: anchoring, projection, scenario summaries, contrast and band tables.

Entities are customers, scenarios are order priorities, and the drivers are a customer's
mean order quantity and discount per year and priority.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators.sizing import kept
from panelyard.functions.numeric import log1p_square, log_of
from panelyard.operators.baseline import baseline_average, baseline_by_group
from panelyard.operators.columns import tag
from panelyard.operators.contrast import (
    factor_table, milestone_means, pct_change_table, report_table, stack_milestones,
)
from panelyard.operators.figures import band_table
from panelyard.operators.filters import exclude, period_between
from panelyard.operators.joins import attach_dim
from panelyard.operators.models import coef_sets, fit_within
from panelyard.operators.projection import anchor_intercepts, coef_table, project, scenario_summary
from panelyard.plans.panels import (
    SQL_CUSTOMER_PANEL, SQL_DIM, customer_cells, customer_index, customer_panel, customer_year, load, nation_dim, panel_of,
)
from panelyard.plans.queries_models import SQL_SLOPES, SQL_WITHIN_SUMS, rounded
from panelyard.plans.queries_prep import multi_region
from panelyard.plans.registry import query
from panelyard.plans.settings import RATIO_COEFS

# The published coefficient sets under the names of the driver tables' two terms.
COEFS = {s: {"a": t["gdppc"], "b": t["education"]} for s, t in RATIO_COEFS.items()}
ANCHOR, YEARS, BASE_YEARS = 1998, (1999, 2000, 2001), (1996, 2000)
REPORTED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
SETS = ("fit", "low", "high")


def scenario_rows(spark, sf, cells=None):
    """Scenario drivers: customer x year x priority, years after the anchor."""
    if cells is None:
        cells = customer_year(spark, sf, terms=True, extra=("o_orderpriority",), years=(YEARS[0], YEARS[-1]))
    rows = period_between(cells, "period", YEARS[0], YEARS[-1])
    rows = rows.select(
        "entity", "period", F.col("o_orderpriority").alias("scenario"),
        (F.col("q_sum") / F.nullif("q_n", F.lit(0))).alias("x1"),
        (F.col("d_sum") / F.nullif("d_n", F.lit(0))).alias("x2"),
    )
    return exclude(rows, "entity", [3, 5, 8])


def scenario_terms():
    return {"a": log_of("x1"), "b": log1p_square("x2")}


def panel_terms():
    return {"a": F.col("a"), "b": F.col("b")}


def projection(spark, sf, coefs=None, cells=None):
    """Anchors and drivers both come from one table of parts: one pass over the lines."""
    coefs = coefs or COEFS
    cells = customer_cells(spark, sf, (ANCHOR, YEARS[-1])) if cells is None else cells
    anchored = panel_of(cells.filter(F.col("period") == ANCHOR))
    anchors = anchor_intercepts(anchored, "entity", "period", "y", panel_terms(), coefs, ANCHOR)
    return project(scenario_rows(spark, sf, cells), anchors, "entity", scenario_terms(), coefs)


def customer_groups(spark, sf):
    """customer -> region, income group, class."""
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("entity")
    )
    return attach_dim(customers, nation_dim(spark, sf), "entity").select(
        F.col("customer").alias("entity"), "region", "income_group", "classification"
    )


def customer_regions(spark, sf):
    """customer -> every region it counts for, 'Global' included."""
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("entity")
    )
    return attach_dim(customers, multi_region(spark, sf), "entity", fanout=True).select(
        F.col("customer").alias("entity"), "region"
    )


def _with_groups(spark, sf):
    return projection(spark, sf).join(customer_groups(spark, sf), "entity", "left")


def _sql_linear(a: str, b: str, name: str) -> str:
    return f"({COEFS[name]['a']} * {a} + {COEFS[name]['b']} * {b})"


SQL_ANCHOR = "anchor AS (SELECT entity, " + ", ".join(
    f"y - {_sql_linear('a', 'b', s)} AS i_{s}" for s in SETS
) + f" FROM frame WHERE period = {ANCHOR})"

SQL_PROJ = f"""{SQL_CUSTOMER_PANEL}, {SQL_ANCHOR},
scen AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority AS scenario,
         avg(q) AS x1, avg(d) AS x2 FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
         WHERE year(o_orderdate) BETWEEN 1999 AND 2001 AND o_custkey NOT IN (3, 5, 8) GROUP BY 1, 2, 3),
proj AS (SELECT scen.*, """ + ", ".join(
    f"i_{s} + {_sql_linear('ln(x1)', 'ln(1 + x2 * x2)', s)} AS proj_{s}" for s in SETS
) + " FROM scen LEFT JOIN anchor ON anchor.entity = scen.entity)"

SQL_GROUPS = f"{SQL_DIM}, cg AS (SELECT c_custkey AS customer, region, income_group, classification FROM customer JOIN dim ON c_nationkey = entity)"


def _sql_summary(group: str) -> str:
    return f"""{SQL_PROJ}, {SQL_GROUPS},
summ AS (SELECT {group}, scenario, period,
  avg(proj_fit) AS index_fit, avg(proj_high) AS index_upr, avg(proj_low) AS index_lwr,
  avg(exp(proj_fit)) AS exp_index_fit, avg(exp(proj_high)) AS exp_index_upr, avg(exp(proj_low)) AS exp_index_lwr
  FROM proj JOIN cg ON entity = customer WHERE {group} IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_ANCHOR}
SELECT entity, {", ".join(f"round(i_{s}, 6) AS intercept_{s}" for s in SETS)} FROM anchor""")
def anchored_intercepts(spark, sf):
    return rounded(anchor_intercepts(customer_panel(spark, sf, (ANCHOR, ANCHOR)), "entity", "period", "y", panel_terms(), COEFS, ANCHOR))


@query(f"""WITH {SQL_PROJ}
SELECT entity, period, scenario, {", ".join(f"round(proj_{s}, 6) AS proj_{s}" for s in SETS)} FROM proj""")
def scenario_projection(spark, sf):
    return rounded(projection(spark, sf).select("entity", "period", "scenario", *[f"proj_{s}" for s in SETS]))


@query(f"""WITH {SQL_PROJ}
SELECT entity, period, scenario, {", ".join(f"round(exp({_sql_linear('ln(x1)', 'ln(1 + x2 * x2)', s)}), 6) AS proj_{s}" for s in SETS)} FROM scen""")
def projection_without_effects(spark, sf):
    """Levels projected from the slopes alone."""
    rows = project(scenario_rows(spark, sf), None, "entity", scenario_terms(), COEFS, level=True)
    return rounded(rows.select("entity", "period", "scenario", *[f"proj_{s}" for s in SETS]))


@query(f"""SELECT o_orderpriority AS scenario, c.term, c."set",
  round(avg(c.value * ln(o_totalprice)), 6) AS effect FROM orders,
  (VALUES {", ".join(f"('{s}', '{t}', {v}::DOUBLE)" for s, d in COEFS.items() for t, v in d.items())}) AS c("set", term, value)
GROUP BY 1, 2, 3""")
def coefficient_effects(spark, sf):
    """Mean log price per scenario under every coefficient row."""
    means = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.avg(F.ln("o_totalprice")).alias("x")
    )
    sets = coef_table(spark, COEFS).agg(F.collect_list(F.struct("set", "term", "value"))).scalar()
    rows = means.select("scenario", "x", F.inline(sets))
    return rounded(rows.select("scenario", "term", "set", (F.col("value") * F.col("x")).alias("effect")))


@query(f"""WITH {_sql_summary('region')}
SELECT p.entity, p.period, p.scenario, s.region, round(proj_fit, 6) AS proj_fit, round(index_fit, 6) AS index_fit,
  round(index_upr, 6) AS index_upr, round(index_lwr, 6) AS index_lwr, round(exp_index_fit, 2) AS exp_index_fit
FROM proj p JOIN cg ON p.entity = customer JOIN summ s ON cg.region = s.region AND p.scenario = s.scenario AND p.period = s.period""")
def region_summary_rows(spark, sf):
    rows = scenario_summary(kept(_with_groups(spark, sf)), "region", period="period")
    return rows.select(
        "entity", "period", "scenario", "region",
        *[F.round(c, 6).alias(c) for c in ("proj_fit", "index_fit", "index_upr", "index_lwr")],
        F.round("exp_index_fit", 2).alias("exp_index_fit"),
    )


def _sql_group_summary(group: str) -> str:
    return f"""WITH {_sql_summary(group)} SELECT {group}, scenario, period, round(index_fit, 6) AS index_fit,
  round(index_upr, 6) AS index_upr, round(index_lwr, 6) AS index_lwr FROM summ"""


@query(_sql_group_summary("income_group"))
def income_summary(spark, sf):
    return rounded(
        scenario_summary(_with_groups(spark, sf), "income_group", period="period", levels=False, collapse=True)
    )


@query(_sql_group_summary("classification"))
def class_summary(spark, sf):
    return rounded(
        scenario_summary(_with_groups(spark, sf), "classification", period="period", levels=False, collapse=True)
    )


def _region_collapsed(spark, sf):
    return scenario_summary(_with_groups(spark, sf), "region", period="period", collapse=True)


@query(f"""WITH {_sql_summary('region')} SELECT region, scenario, period, round(index_fit, 6) AS fit,
  round(index_lwr, 6) AS lwr, round(index_upr, 6) AS upr FROM summ
WHERE period > 1999 AND scenario NOT IN ('4-NOT SPECIFIED', '5-LOW')""")
def band(spark, sf):
    return rounded(band_table(
        _region_collapsed(spark, sf), "region", period="period", after=1999, leave_out=["4-NOT SPECIFIED", "5-LOW"]
    ))


@query(f"""WITH {_sql_summary('region')} SELECT region, scenario, period, round(index_fit, 6) AS fit,
  round(index_lwr, 6) AS lwr, round(index_upr, 6) AS upr FROM summ WHERE scenario = '2-HIGH'""")
def band_one_scenario(spark, sf):
    return rounded(band_table(_region_collapsed(spark, sf), "region", period="period", only=["2-HIGH"]))


@query(f"""WITH {_sql_summary('region')} SELECT region, scenario, period, round(exp_index_fit, 2) AS fit,
  round(exp_index_lwr, 2) AS lwr, round(exp_index_upr, 2) AS upr FROM summ WHERE period > 1999""")
def band_level(spark, sf):
    return rounded(band_table(_region_collapsed(spark, sf), "region", period="period", after=1999, scale="level"), 2)


# --- contrast tables -------------------------------------------------------------------

SQL_MULTI = f"""{SQL_DIM}, multi AS (SELECT entity, region FROM dim WHERE region IS NOT NULL
  UNION ALL SELECT entity, 'Global' FROM dim),
cr AS (SELECT c_custkey AS customer, region FROM customer LEFT JOIN multi ON c_nationkey = entity)"""

SQL_BASE = """bw AS (SELECT entity, period, y, region, avg(y) OVER (PARTITION BY region) AS average
  FROM frame LEFT JOIN cr ON entity = customer WHERE period BETWEEN 1996 AND 2000),
base AS (SELECT * FROM bw WHERE period = 1998)"""


def base_rows(spark, sf, index=None):
    index = customer_index(spark, sf, BASE_YEARS) if index is None else index
    rows = kept(index).join(customer_regions(spark, sf), "entity", "left")
    return baseline_average(rows, "region", "period", {"y": "average"}, BASE_YEARS, ANCHOR)


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_MULTI}, {SQL_BASE}
SELECT entity, period, region, round(y, 6) AS y, round(average, 6) AS average FROM base""")
def group_mean_years(spark, sf):
    return rounded(base_rows(spark, sf))


SQL_MEANS = f"""{SQL_PROJ}, {SQL_MULTI}, {SQL_BASE},
stacked AS (SELECT scenario, entity, region, period, proj_fit FROM proj LEFT JOIN cr ON entity = customer
  UNION ALL SELECT 'Baseline', entity, region, period, NULL FROM base),
means AS (SELECT region, scenario, """ + ", ".join(
    f"avg(proj_fit) FILTER (WHERE period = {y}) AS mean_proj_{y}" for y in YEARS
) + """ FROM stacked GROUP BY 1, 2),
joined AS (SELECT means.*, average FROM means LEFT JOIN (SELECT DISTINCT region, average FROM base) b
  ON means.region IS NOT DISTINCT FROM b.region)"""


def _contrast_parts(spark, sf):
    cells = customer_cells(spark, sf, (BASE_YEARS[0], YEARS[-1]))   # read by baseline, anchors and drivers
    index = panel_of(cells).select("entity", "period", "y")
    base = kept(tag(base_rows(spark, sf, index), scenario="Baseline", source="index"))
    proj = projection(spark, sf, cells=cells).join(customer_regions(spark, sf), "entity", "left")
    stacked = stack_milestones(tag(proj, source="proj"), base, "period", (ANCHOR, *YEARS)).select(
        "scenario", "entity", "region", "period", "proj_fit", "source", "average"
    )
    return milestone_means(stacked, ["region", "scenario"], "period", "proj_fit", YEARS), base


@query(f"""WITH {SQL_MEANS} SELECT region, scenario, {", ".join(f"round(mean_proj_{y}, 6) AS mean_proj_{y}" for y in YEARS)} FROM means""")
def region_milestones(spark, sf):
    return rounded(_contrast_parts(spark, sf)[0])


@query(f"""WITH {SQL_MEANS} SELECT region, scenario, round(average, 6) AS average,
{", ".join(f"round(mean_proj_{y}, 6) AS mean_proj_{y}, round((mean_proj_{y} - average) / average * 100, 6) AS diff_{y}" for y in YEARS)} FROM joined""")
def pct_change(spark, sf):
    means, base = _contrast_parts(spark, sf)
    return rounded(pct_change_table(means, base, "region", "average", YEARS))


@query(f"""WITH {SQL_MEANS} SELECT region, scenario, round(average, 6) AS average,
{", ".join(f"round(mean_proj_{y}, 6) AS mean_proj_{y}, round(mean_proj_{y} / average, 6) AS factor_diff_{y}" for y in YEARS)} FROM joined""")
def factor_change(spark, sf):
    means, base = _contrast_parts(spark, sf)
    return rounded(factor_table(means, base, "region", "average", YEARS))


SQL_REPORTED = "WHERE scenario IN (" + ", ".join(f"'{s}'" for s in REPORTED) + ")"


@query(f"""WITH {SQL_MEANS} SELECT region, scenario, round(average, 2) AS average,
{", ".join(f"round((mean_proj_{y} - average) / average * 100, 2) AS diff_{y}" for y in YEARS)} FROM joined {SQL_REPORTED}""")
def pct_report(spark, sf):
    means, base = _contrast_parts(spark, sf)
    table = pct_change_table(means, base, "region", "average", YEARS)
    return report_table(table, REPORTED, ["average", *[f"diff_{y}" for y in YEARS]])


@query(f"""WITH {SQL_MEANS} SELECT region, scenario, round(average, 2) AS average,
{", ".join(f"round(mean_proj_{y} / average, 2) AS factor_diff_{y}" for y in YEARS)} FROM joined {SQL_REPORTED}""")
def factor_report(spark, sf):
    means, base = _contrast_parts(spark, sf)
    table = factor_table(means, base, "region", "average", YEARS)
    return report_table(table, REPORTED, ["average", *[f"factor_diff_{y}" for y in YEARS]])


@query(f"""WITH {SQL_PROJ},
means AS (SELECT entity, {", ".join(f"avg(proj_fit) FILTER (WHERE period = {y}) AS mean_proj_{y}" for y in YEARS)}
  FROM (SELECT entity, period, proj_fit FROM proj UNION ALL SELECT entity, period, NULL FROM frame WHERE period = 1998)
  GROUP BY entity)
SELECT means.entity, round(y, 6) AS y, {", ".join(f"round(mean_proj_{y}, 6) AS mean_proj_{y}, round((mean_proj_{y} - y) / y * 100, 6) AS diff_{y}" for y in YEARS)}
FROM means LEFT JOIN frame ON frame.entity = means.entity AND frame.period = 1998""")
def entity_pct_change(spark, sf):
    cells = customer_cells(spark, sf, (ANCHOR, YEARS[-1]))
    base = panel_of(cells.filter(F.col("period") == ANCHOR)).select("entity", "period", "y")
    stacked = stack_milestones(projection(spark, sf, cells=cells), base, "period", (ANCHOR, *YEARS))
    means = milestone_means(stacked, ["entity"], "period", "proj_fit", YEARS)
    return rounded(pct_change_table(means, base, "entity", "y", YEARS))


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_GROUPS}
SELECT classification, round(avg(y), 6) AS baseline, round(avg(exp(y)), 2) AS exp_baseline
FROM frame JOIN cg ON entity = customer WHERE period BETWEEN 1998 AND 2000 GROUP BY 1""")
def class_baseline(spark, sf):
    rows = customer_index(spark, sf, (1998, 2000)).join(customer_groups(spark, sf), "entity")
    table = baseline_by_group(
        rows, "classification", "y", period="period", years=(1998, 2000), collapse=True, drop_null_group=True
    )
    return table.select(
        "classification", F.round("baseline", 6).alias("baseline"), F.round("exp_baseline", 2).alias("exp_baseline")
    )


# --- from fit to projected bands in one go ---------------------------------------------

@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}, {SQL_GROUPS},
c AS (SELECT ba, bb, 1.959963984540054 * sqrt(ssr / (n - g - 2) * sbb / (saa * sbb - sab * sab)) AS ha,
             1.959963984540054 * sqrt(ssr / (n - g - 2) * saa / (saa * sbb - sab * sab)) AS hb FROM r),
scen AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority AS scenario,
         avg(q) AS x1, avg(d) AS x2 FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
         WHERE year(o_orderdate) BETWEEN 1999 AND 2001 AND o_custkey NOT IN (3, 5, 8) GROUP BY 1, 2, 3),
j AS (SELECT scen.entity, scen.period, scenario, region, y, ln(x1) - a AS da, ln(1 + x2 * x2) - b AS db, ba, bb, ha, hb
      FROM scen JOIN cg ON scen.entity = customer LEFT JOIN frame ON frame.entity = scen.entity AND frame.period = 1998, c)
SELECT region, scenario, period, round(avg(y + ba * da + bb * db), 5) AS fit,
  round(avg(y + (ba - ha) * da + (bb - hb) * db), 5) AS lwr, round(avg(y + (ba + ha) * da + (bb + hb) * db), 5) AS upr
FROM j WHERE region IS NOT NULL GROUP BY 1, 2, 3""")
def fitted_bands(spark, sf):
    """Fit with entity effects, take its limits as coefficient sets, re-anchor, project, summarise."""
    cells = customer_cells(spark, sf)
    coefs = coef_sets(fit_within(panel_of(cells), "y", ["a", "b"], "entity"))
    proj = projection(spark, sf, coefs, cells).join(customer_groups(spark, sf), "entity", "left")
    summary = scenario_summary(proj, "region", period="period", collapse=True)
    return rounded(band_table(summary, "region", period="period"), 5)
