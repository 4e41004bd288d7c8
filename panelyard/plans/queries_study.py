"""Registered queries that run a whole study on tables mapped from the driver tables.

Nations are the areas; an order year y stands for y + 5 in the level study and for y + 7 in the
ratio study, so that their reference and anchor years have data, and days of the month for the
scenario years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.sizing import measured
from panelyard.plans.panels import SQL_DIM, load, nation_dim, nation_year
from panelyard.plans.queries_models import rounded
from panelyard.plans.queries_prep import multi_region
from panelyard.plans.registry import query
from panelyard.plans.settings import BASELINE_AT, BASELINE_YEARS, LEVEL_SLOPE, MILESTONES, RATIO_COEFS, SCENARIO_GRID
from panelyard.plans.study import level_study, ratio_study

SHIFT, RATIO_SHIFT, ANCHOR = 5, 7, 2008
WIDE_YEARS = range(1975, 2020)   # positions 6 to 50 of the level study's wide table


def wide(history: DataFrame, value: str, years, prefix: str) -> DataFrame:
    """A row per area with a column per year."""
    return history.groupBy("countrycode").agg(
        *[F.max(F.when(F.col("year") == y, F.col(value))).alias(f"{prefix}{y}") for y in years]
    )


def level_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The level study's inputs."""
    code = F.format_string("N%02d", F.col("entity")).alias("countrycode")
    history = nation_year(spark, sf).select(code, (F.col("period") + SHIFT).alias("year"), "num", (F.col("num") / F.col("den")).alias("gdppc"))

    machinery = wide(history, "num", WIDE_YEARS, "").withColumnRenamed("countrycode", "Country Code")
    lead = [F.lit(None).cast("string").alias(c) for c in ("Country Name", "Indicator Name", "Indicator Code", "Unit")]
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    drivers = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy(
        F.col("c_nationkey").alias("entity"),
        (2020 + 5 * (F.dayofmonth("o_orderdate") % 17)).alias("year"),
        F.concat(F.lit("SSP"), F.substring("o_orderpriority", 1, 1)).alias("scenario"),
    ).agg(F.avg("o_totalprice").alias("gdppc"))
    dim = nation_dim(spark, sf)
    return {
        "machinery_wide": machinery.select("Country Code", *lead, *[F.col(str(y)) for y in WIDE_YEARS]),
        "gdppc_wide": wide(history, "gdppc", range(1960, 2020), "X").withColumnRenamed("countrycode", "Country.Code"),
        "scenarios": drivers.select(code, "year", "scenario", "gdppc"),
        "regions": dim.select(code, "region"),
        "regions_global": multi_region(spark, sf).select(code, "region"),
        "income_group": dim.select(code, "income_group"),
        "development_class": dim.select(code, "classification"),
    }


_MEANS = ", ".join(f"avg(fit) FILTER (WHERE year = {y}) AS m_{y}" for y in MILESTONES)
_COLUMNS = ", ".join(
    f"round(m_{y}, 6) AS mean_proj_{y}, round((m_{y} - average_2005) / average_2005 * 100, 6) AS diff_{y}" for y in MILESTONES
)


@query(f"""WITH {SQL_DIM},
ny AS (SELECT c_nationkey AS entity, year(o_orderdate) + {SHIFT} AS year, sum(o_totalprice) AS num,
              sum(o_totalprice) / count(DISTINCT o_custkey) AS gdp
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ref AS (SELECT k.entity, ln(num) AS il, ln(gdp) AS lg FROM (SELECT DISTINCT entity FROM ny) k
        LEFT JOIN ny ON ny.entity = k.entity AND year = {BASELINE_AT}),
rg AS (SELECT entity, region FROM dim WHERE region IS NOT NULL UNION ALL SELECT entity, 'Global' FROM dim),
base AS (SELECT region, avg(il) AS average_2005 FROM ref JOIN rg ON rg.entity = ref.entity GROUP BY region),
sc AS (SELECT c_nationkey AS entity, 2020 + 5 * (day(o_orderdate) % 17) AS year, 'SSP' || substr(o_orderpriority, 1, 1) AS scenario,
              avg(o_totalprice) AS g FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
proj AS (SELECT sc.*, il - {LEVEL_SLOPE} * lg + {LEVEL_SLOPE} * ln(g) AS fit FROM sc JOIN ref ON ref.entity = sc.entity),
stacked AS (SELECT scenario, region, year, fit FROM proj JOIN rg ON rg.entity = proj.entity WHERE year IN {MILESTONES}
            UNION ALL SELECT NULL, region, {BASELINE_AT}, NULL FROM ref JOIN rg ON rg.entity = ref.entity),
means AS (SELECT region, scenario, {_MEANS} FROM stacked GROUP BY 1, 2)
SELECT means.region, scenario, round(average_2005, 6) AS average_2005, {_COLUMNS} FROM means LEFT JOIN base ON base.region = means.region""")
def study_level_contrast(spark, sf):
    """Percent changes of the level study from its raw inputs on."""
    table = level_study(level_tables(spark, sf))["pct_change"]
    columns = [c for y in MILESTONES for c in (f"mean_proj_{y}", f"diff_{y}")]
    return rounded(table.select("region", "scenario", "average_2005", *columns))


def ratio_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The ratio study's inputs: names in place of codes, numbers as text, wide and long tables."""
    code = F.format_string("N%02d", F.col("entity")).alias("countrycode")
    orders = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))

    # Customers first: a distinct count would expand every order.
    per_customer = orders.groupBy(F.col("c_nationkey").alias("entity"), (F.year("o_orderdate") + RATIO_SHIFT).alias("year"), "o_custkey").agg(
        F.sum("o_totalprice").alias("num"), F.count("*").alias("n"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("high"),
    )
    # Rows per nation and year, which every input below comes from: measured, so that orders are read
    # once and the study sees their true size in place of the planner's product of joined tables.
    history = measured(per_customer.groupBy("entity", "year").agg(
        F.sum("num").alias("num"), F.count("*").alias("den"), F.sum("n").alias("n"), F.sum("urgent").alias("urgent"), F.sum("high").alias("high")
    ).select(
        code, "year", "num", "den", F.col("n").cast("double").alias("gdppc"), (F.col("n") / F.col("den")).alias("urbanization"),
        (F.col("urgent") / F.col("n")).alias("education"), (100 * F.col("high") / F.col("n")).alias("agri"),
    ))[0]
    drivers = measured(orders.groupBy(
        F.col("c_nationkey").alias("entity"), (2020 + 5 * (F.dayofmonth("o_orderdate") % 17)).alias("year"),
        F.concat(F.lit("SSP"), F.substring("o_orderpriority", 1, 1)).alias("scenario"),
    ).agg(
        F.avg("o_totalprice").alias("gdppc"), F.avg(F.month("o_orderdate").cast("double")).alias("urbanization"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("postsec"),
    ))[0]
    dim = measured(nation_dim(spark, sf).select(code, "n_name", "region", "income_group", "classification"))[0]
    named = history.join(dim.select("countrycode", "n_name"), "countrycode")
    return {
        "production": named.select(F.initcap("n_name").alias("Area"), F.col("year").alias("Year"), F.col("num").cast("string").alias("Value")),
        "employment": named.select(
            F.col("n_name").alias("Area"), F.col("year").alias("Year"), F.explode(F.array(F.lit("Total"), F.lit("Male"))).alias("Sex"),
            F.col("den").cast("string").alias("Value"),
        ),
        "aliases": dim.select(F.col("n_name").alias("alias"), "countrycode"),
        "regions": dim.select("countrycode", "region"),
        "regions_global": multi_region(spark, sf).select(code, "region"),
        "income_group": dim.select("countrycode", "income_group"),
        "development_class": dim.select("countrycode", "classification"),
        "gdppc_wide": wide(history, "gdppc", range(1960, 2020), "X").withColumnRenamed("countrycode", "Country.Code"),
        "urbanization_wide": wide(history, "urbanization", range(1950, 2091), "").withColumnRenamed("countrycode", "country or area"),
        "education": history.select("countrycode", "year", F.col("education").alias("post.secondary")),
        "labour_share": history.select(
            F.col("countrycode").alias("Entity"), F.col("countrycode").alias("Code"), F.col("year").alias("Year"), F.col("agri").alias("share_employed_agri")
        ),
        "scenarios": drivers.select(code, "year", "scenario", "postsec", "gdppc", "urbanization"),
    }


_B = RATIO_COEFS["fit"]


def _sql_part(gdppc: str, urbanization: str, education: str) -> str:
    return f"({_B['gdppc']} * ln({gdppc}) + {_B['urbanization']} * ln({urbanization}) + {_B['education']} * ln(1 + {education}))"


@query(f"""WITH {SQL_DIM},
ny AS (SELECT c_nationkey AS entity, year(o_orderdate) + {RATIO_SHIFT} AS year, sum(o_totalprice) AS num, count(DISTINCT o_custkey) AS den, count(*) AS n,
              count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
rg AS (SELECT entity, region FROM dim WHERE region IS NOT NULL UNION ALL SELECT entity, 'Global' FROM dim),
panel AS (SELECT entity, year, ln(num / (den * 1000)) AS il FROM ny),
base AS (SELECT region, avg(il) AS average_2005 FROM panel JOIN rg ON rg.entity = panel.entity
         WHERE year BETWEEN {BASELINE_YEARS[0]} AND {BASELINE_YEARS[1]} GROUP BY region),
anchor AS (SELECT ny.entity, il - {_sql_part('n', 'n / den', 'urgent / n')} AS intercept
           FROM ny JOIN panel ON panel.entity = ny.entity AND panel.year = ny.year JOIN rg ON rg.entity = ny.entity WHERE ny.year = {ANCHOR}),
sc AS (SELECT c_nationkey AS entity, 2020 + 5 * (day(o_orderdate) % 17) AS year, 'SSP' || substr(o_orderpriority, 1, 1) AS scenario,
              avg(o_totalprice) AS g, avg(month(o_orderdate)) AS u, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS e
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
proj AS (SELECT sc.entity, year, scenario, intercept + {_sql_part('g', 'u', 'e')} AS fit FROM sc JOIN anchor ON anchor.entity = sc.entity
         WHERE year BETWEEN {SCENARIO_GRID[0]} AND {SCENARIO_GRID[1]}),
stacked AS (SELECT scenario, region, year, fit FROM proj JOIN rg ON rg.entity = proj.entity WHERE year IN {MILESTONES}
            UNION ALL SELECT 'Baseline', region, {BASELINE_AT}, NULL FROM panel JOIN rg ON rg.entity = panel.entity WHERE year = {BASELINE_AT}),
means AS (SELECT region, scenario, {_MEANS} FROM stacked GROUP BY 1, 2)
SELECT means.region, scenario, round(average_2005, 6) AS average_2005, {_COLUMNS} FROM means LEFT JOIN base ON base.region = means.region""")
def study_ratio_contrast(spark, sf):
    """Percent changes of the ratio study from its raw inputs on."""
    table = ratio_study(ratio_tables(spark, sf), anchor=ANCHOR)["pct_change"]
    columns = [c for y in MILESTONES for c in (f"mean_proj_{y}", f"diff_{y}")]
    return rounded(table.select("region", "scenario", "average_2005", *columns))
