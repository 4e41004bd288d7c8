"""Registered queries: preparation, joins, sets, baselines and distribution tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators.sizing import kept
from panelyard.functions.numeric import log1p_of, log1p_square, log_of, log_square, to_double, to_int
from panelyard.operators.baseline import (
    baseline_average, baseline_by_group, entity_snapshot, group_bounds, lag_rows,
)
from panelyard.operators.columns import (
    add_terms, build_level_index, build_ratio_index, columns_between, lower_names, minmax, rescale, scatter_table, tag,
)
from panelyard.operators.filters import (
    complete_cases, exclude, exclude_listed, exclude_where, keep_groups_with_data, period_between, period_grid,
)
from panelyard.operators.figures import cutoff_lines
from panelyard.operators.joins import (
    attach_baseline, attach_dim, choropleth_table, join_panel, normal_name, resolve_entity,
)
from panelyard.operators.names import match_names
from panelyard.operators.reshape import melt_years, pivot_mean
from panelyard.operators.sets import distinct_values, union_fill, with_order_key
from panelyard.operators.summary import (
    count_above, density_column, describe_index, extreme_entity, histogram_table, key_figures,
    normal_density, summary_table,
)
from panelyard.plans.panels import (
    SQL_CUSTOMER_YEAR, SQL_DIM, SQL_LINES, SQL_NATION_YEAR,
    customer_year, in_years, index_panel, load, month_key, nation_dim, nation_year, order_terms,
)
from panelyard.plans.registry import query
from panelyard.plans.settings import INCOME_LEVELS, RATIO_CUTOFFS

YEARS = list(range(1995, 2002))


# --- preparation -----------------------------------------------------------------------

@query(f"""WITH {SQL_CUSTOMER_YEAR}, {SQL_DIM}
SELECT cy.entity, period, round(num, 2) AS num, region FROM cy JOIN customer ON cy.entity = c_custkey
JOIN dim ON dim.entity = c_nationkey WHERE region IS NOT NULL AND num > 300000""")
def complete_rows(spark, sf):
    """Rows with a NULL in any column go: no region, or a small sum made NULL."""
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("entity"))
    groups = attach_dim(customers, nation_dim(spark, sf), "entity").select("customer", "region")
    panel = customer_year(spark, sf).select("entity", "period", F.when(F.col("num") > 300000, F.col("num")).alias("num"))
    joined = panel.join(groups, panel["entity"] == groups["customer"]).drop("customer")
    return complete_cases(joined).select("entity", "period", F.round("num", 2).alias("num"), "region")


@query(f"""WITH {SQL_NATION_YEAR}
SELECT entity, period, round(num * 1000, 0) AS num, den, round(num * 1000 / den, 4) AS index,
       round(ln(num * 1000 / den), 8) AS index_log, 'Baseline' AS scenario
FROM panel WHERE entity <> 13""")
def ratio_index(spark, sf):
    df = rescale(nation_year(spark, sf), "num", 1000)
    df = exclude(build_ratio_index(complete_cases(df), "num", "den"), "entity", [13])
    return tag(df, scenario="Baseline").select(
        "entity", "period", F.round("num", 0).alias("num"), "den",
        F.round("index", 4).alias("index"), F.round("index_log", 8).alias("index_log"), "scenario",
    )


@query("""SELECT c_custkey AS entity, c_acctbal AS index,
       round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 8) AS index_log
FROM customer""")
def level_index(spark, sf):
    df = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal")
    return build_level_index(df, "c_acctbal").select(
        "entity", "index", F.round("index_log", 8).alias("index_log")
    )


@query("""SELECT o_orderkey, round((o_totalprice - 1000) / (500000 - 1000), 8) AS given_n,
       round((o_totalprice - lo) / (hi - lo), 8) AS own_n
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def minmax_norm(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    df = minmax(df, "o_totalprice", 1000.0, 500000.0, out="given_n")
    return minmax(df, "o_totalprice", out="own_n").select(
        "o_orderkey", F.round("given_n", 8).alias("given_n"), F.round("own_n", 8).alias("own_n")
    )


@query(f"""WITH {SQL_LINES}
SELECT l_orderkey, round(ln(q), 8) AS log_q, round(ln(q * q), 8) AS log_q2,
       round(ln(1 + d), 8) AS log1p_d, round(ln(1 + d * d), 8) AS log1p_d2 FROM lines""")
def model_terms(spark, sf):
    df = add_terms(order_terms(spark, sf), {
        "log_q": log_of("q"), "log_q2": log_square("q"),
        "log1p_d": log1p_of("d"), "log1p_d2": log1p_square("d"),
    })
    return df.select("l_orderkey", *[F.round(c, 8).alias(c) for c in ("log_q", "log_q2", "log1p_d", "log1p_d2")])


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders
WHERE year(o_orderdate) IN (1996, 1998, 2000)""")
def period_grid_filter(spark, sf):
    orders = in_years(load(spark, sf, "orders"), "o_orderdate", 1996, 2001)
    df = orders.select("o_orderkey", F.year("o_orderdate").alias("period"))
    return period_grid(df, "period", 1996, 2001, 2)


@query(f"""WITH {SQL_DIM}
SELECT c_custkey, region FROM customer JOIN dim ON c_nationkey = entity
WHERE region IS NULL OR region NOT IN ('ASIA', 'EUROPE')""")
def exclude_nulls_kept(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    df = attach_dim(df, nation_dim(spark, sf), "entity")
    return exclude(df, "region", ["ASIA", "EUROPE"]).select("c_custkey", "region")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal <= 0)""")
def exclude_by_table(spark, sf):
    negative = load(spark, sf, "customer").filter("c_acctbal <= 0").select("c_custkey")
    return exclude_listed(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", negative)


@query(f"""WITH {SQL_DIM}
SELECT c_custkey, region, c_mktsegment FROM customer JOIN dim ON c_nationkey = entity
WHERE NOT coalesce((region IN ('ASIA', 'EUROPE') AND c_mktsegment = 'BUILDING')
                OR (region = 'AFRICA' AND c_mktsegment = 'MACHINERY'), FALSE)""")
def exclude_compound(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"), "c_mktsegment")
    df = attach_dim(df, nation_dim(spark, sf), "entity")
    segment = F.col("c_mktsegment")
    unwanted = (F.col("region").isin("ASIA", "EUROPE") & (segment == "BUILDING")) | (
        (F.col("region") == "AFRICA") & (segment == "MACHINERY")
    )
    return exclude_where(df, unwanted).select("c_custkey", "region", "c_mktsegment")


@query(f"""WITH {SQL_CUSTOMER_YEAR},
m AS (SELECT entity, period, CASE WHEN num > 600000 THEN num END AS measure FROM cy)
SELECT entity, period, round(measure, 2) AS measure FROM m
WHERE entity IN (SELECT entity FROM m WHERE measure IS NOT NULL)""")
def groups_with_data(spark, sf):
    df = kept(customer_year(spark, sf).select(
        "entity", "period", F.when(F.col("num") > 600000, F.col("num")).alias("measure")
    ))
    return keep_groups_with_data(df, ["entity"], ["measure"]).select(
        "entity", "period", F.round("measure", 2).alias("measure")
    )


@query(f"""WITH {SQL_CUSTOMER_YEAR},
keys AS (SELECT entity, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT entity FROM cy), range(1995, 2002) AS r(y))
SELECT keys.entity, year, round(num, 2) AS value
FROM keys LEFT JOIN cy ON cy.entity = keys.entity AND period = year""")
def melt_year_columns(spark, sf):
    wide = customer_year(spark, sf).groupBy("entity").agg(
        *[F.sum(F.when(F.col("period") == y, F.col("num"))).alias(f"X{y}") for y in YEARS]
    )
    wide = lower_names(wide)
    long = melt_years(wide, ["entity"], columns_between(wide, f"x{YEARS[0]}", f"x{YEARS[-1]}"), "value")
    return long.select("entity", "year", F.round("value", 2).alias("value"))


@query(f"""WITH {SQL_CUSTOMER_YEAR}
SELECT entity, round(avg(num) FILTER (WHERE period = 1995), 2) AS mean_1995,
       round(avg(num) FILTER (WHERE period = 1998), 2) AS mean_1998,
       round(avg(num) FILTER (WHERE period = 2001), 2) AS mean_2001 FROM cy GROUP BY entity""")
def milestone_pivot(spark, sf):
    wide = pivot_mean(customer_year(spark, sf), ["entity"], "period", "num", [1995, 1998, 2001])
    return wide.select("entity", *[F.round(f"mean_{y}", 2).alias(f"mean_{y}") for y in (1995, 1998, 2001)])


@query("""SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END, 1) AS INTEGER) AS rank,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders""")
def tolerant_cast(spark, sf):
    orders = load(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    letter = F.substring("o_orderpriority", F.when(F.col("o_orderstatus") == "F", 3).otherwise(1), F.lit(1))
    return orders.select("o_orderkey", to_int(letter).alias("rank"), to_double(text).alias("price"))


# --- joins and sets --------------------------------------------------------------------

@query(f"""WITH {SQL_NATION_YEAR},
ships AS (SELECT s_nationkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS period, sum(l_extendedprice) AS shipped
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT panel.entity, panel.period, round(num, 2) AS num, round(shipped, 2) AS shipped
FROM panel LEFT JOIN ships ON panel.entity = ships.entity AND panel.period = ships.period""")
def join_two_keys(spark, sf):
    by_supplier = load(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").alias("period")
    ).agg(F.sum("l_extendedprice").alias("shipped"))
    supplier = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity")
    )
    ships = by_supplier.join(supplier, "l_suppkey").groupBy("entity", "period").agg(F.sum("shipped").alias("shipped"))
    joined = join_panel(nation_year(spark, sf).select("entity", "period", "num"), ships, ["entity", "period"])
    return joined.select("entity", "period", F.round("num", 2).alias("num"), F.round("shipped", 2).alias("shipped"))


@query(f"""WITH {SQL_DIM}
SELECT c_custkey, c_nationkey AS entity, region, income_group FROM customer LEFT JOIN dim ON c_nationkey = entity""")
def dim_left_join(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    return attach_dim(df, nation_dim(spark, sf).select("entity", "region", "income_group"), "entity").select(
        "c_custkey", "entity", "region", "income_group"
    )


@query(f"""WITH {SQL_DIM},
multi AS (SELECT entity, region FROM dim WHERE region IS NOT NULL UNION ALL SELECT entity, 'Global' FROM dim)
SELECT c_custkey, region FROM customer LEFT JOIN multi ON c_nationkey = entity""")
def dim_fanout(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    return attach_dim(df, multi_region(spark, sf), "entity", fanout=True).select("c_custkey", "region")


def multi_region(spark, sf):
    """nation -> its region and 'Global'."""
    dim = nation_dim(spark, sf)
    own = dim.filter("region IS NOT NULL").select("entity", "region")
    return own.unionAll(dim.select("entity", F.lit("Global").alias("region")))


@query(f"""WITH {SQL_NATION_YEAR}, {SQL_DIM},
rows AS (SELECT panel.*, region FROM panel JOIN dim ON panel.entity = dim.entity),
base AS (SELECT region, avg(index_log) AS baseline FROM rows WHERE period BETWEEN 1996 AND 2000 GROUP BY region),
means AS (SELECT region, period, avg(index_log) AS mean_log FROM rows GROUP BY 1, 2)
SELECT means.region, period, round(mean_log, 6) AS mean_log, round(baseline, 6) AS baseline
FROM means LEFT JOIN base ON means.region IS NOT DISTINCT FROM base.region""")
def baseline_attach(spark, sf):
    rows = kept(attach_dim(index_panel(spark, sf), nation_dim(spark, sf), "entity"))
    base = baseline_by_group(rows, "region", "index_log", period="period", years=(1996, 2000))
    means = rows.groupBy("region", "period").agg(F.avg("index_log").alias("mean_log"))
    return attach_baseline(means, base, "region", "baseline").select(
        "region", "period", F.round("mean_log", 6).alias("mean_log"), F.round("baseline", 6).alias("baseline")
    )


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE n_nationkey END AS code
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resolve_alias(spark, sf):
    nation = load(spark, sf, "nation")
    spelled = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "Atlantis")
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("  "), F.lower("n_name")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.regexp_replace("n_name", "_", " - "))
        .otherwise(F.col("n_name"))
    )
    raw = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", spelled.alias("name")
    )
    aliases = nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("code"))
    return resolve_entity(raw, "name", aliases, code="code").select("c_custkey", "code")


@query("""SELECT r_name AS region, income_group, cutoff FROM region,
  (VALUES ('High income', 3.16::DOUBLE), ('Lower middle income', 0.79::DOUBLE), ('Upper middle income', 1.48::DOUBLE))
  AS c(income_group, cutoff)
WHERE NOT ((r_name IN ('EUROPE', 'ASIA') AND income_group = 'Lower middle income')
        OR (r_name = 'EUROPE' AND income_group = 'Upper middle income'))""")
def cutoff_grid_lines(spark, sf):
    regions = load(spark, sf, "region").select(F.col("r_name").alias("region"))
    hidden = [(["EUROPE", "ASIA"], "Lower middle income"), (["EUROPE"], "Upper middle income")]
    return cutoff_lines(regions, RATIO_CUTOFFS, hidden)


@query(f"""WITH {SQL_NATION_YEAR}, {SQL_DIM}, v AS (SELECT panel.entity, CASE WHEN region <> 'ASIA' THEN index_log END AS value
  FROM panel JOIN dim ON dim.entity = panel.entity WHERE period = 1998)
SELECT c_nationkey AS entity, n_name AS id, c_custkey AS "order", round(value, 8) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN v ON v.entity = c_nationkey""")
def choropleth(spark, sf):
    nation = load(spark, sf, "nation")
    shapes = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("entity"), F.col("n_name").alias("id"), F.col("c_custkey").alias("order")
    )
    rows = attach_dim(index_panel(spark, sf, (1998, 1998)), nation_dim(spark, sf), "entity")
    shown = F.when(F.col("region") != "ASIA", F.round("index_log", 8))   # polygons without a value
    values = rows.filter("period = 1998").select("entity", shown.alias("value"))
    return choropleth_table(values, shapes, "entity")


@query("""SELECT o_orderkey AS key, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer""")
def union_by_name(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    customers = load(spark, sf, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key")
    )
    return union_fill(orders, customers).select("key", "price", "balance")


@query(f"""WITH {SQL_DIM}
SELECT c_custkey, income_group,
  CASE income_group WHEN 'Lower middle income' THEN 1 WHEN 'Upper middle income' THEN 2 WHEN 'High income' THEN 3 END AS up,
  CASE income_group WHEN 'Lower middle income' THEN 3 WHEN 'Upper middle income' THEN 2 WHEN 'High income' THEN 1 END AS down
FROM customer JOIN dim ON c_nationkey = entity""")
def category_order(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    df = attach_dim(df, nation_dim(spark, sf), "entity").select("c_custkey", "income_group")
    df = with_order_key(df, "income_group", INCOME_LEVELS, "up")
    return with_order_key(df, "income_group", INCOME_LEVELS, "down", reverse=True)


@query("""SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS period FROM orders""")
def distinct_periods(spark, sf):
    return distinct_values(load(spark, sf, "orders").select(F.year("o_orderdate").alias("period")), "period")


# --- baselines and lags ----------------------------------------------------------------

@query(f"""WITH {SQL_CUSTOMER_YEAR},
w AS (SELECT *, avg(ln(num / orders)) OVER (PARTITION BY entity) AS average,
      avg(num) OVER (PARTITION BY entity) AS average_num FROM cy WHERE period BETWEEN 1996 AND 2000)
SELECT entity, period, round(ln(num / orders), 6) AS index_log, round(average, 6) AS average,
       round(average_num, 4) AS average_num FROM w WHERE period = 1998""")
def entity_baseline(spark, sf):
    df = kept(build_ratio_index(customer_year(spark, sf, years=(1996, 2000)), "num", "orders"))
    out = baseline_average(
        df, "entity", "period", {"index_log": "average", "num": "average_num"}, (1996, 2000), 1998
    )
    return out.select(
        "entity", "period", F.round("index_log", 6).alias("index_log"), F.round("average", 6).alias("average"),
        F.round("average_num", 4).alias("average_num"),
    )


SQL_SCENARIO_BASELINE = f"""WITH {SQL_NATION_YEAR}, {SQL_DIM},
w AS (SELECT panel.*, region, avg(index_log) OVER (PARTITION BY panel.entity) AS average
      FROM panel LEFT JOIN dim ON panel.entity = dim.entity WHERE period BETWEEN 1996 AND 2000)
SELECT entity, period, region, round(index_log, 6) AS index_log, round(average, 6) AS average,
       round(avg(index_log) OVER (PARTITION BY region), 6) AS baseline,
       round(avg(exp(index_log)) OVER (PARTITION BY region), 2) AS exp_baseline
FROM w WHERE period = 1998"""


@query(SQL_SCENARIO_BASELINE)
def scenario_baseline(spark, sf):
    """Orders and customers to a nation panel, its index, entity baseline and region baseline."""
    df = baseline_average(
        kept(index_panel(spark, sf, (1996, 2000))), "entity", "period", {"index_log": "average"}, (1996, 2000), 1998
    )
    df = attach_dim(df, nation_dim(spark, sf).select("entity", "region"), "entity")
    out = baseline_by_group(df, "region", "index_log")
    return out.select(
        "entity", "period", "region", F.round("index_log", 6).alias("index_log"),
        F.round("average", 6).alias("average"), F.round("baseline", 6).alias("baseline"),
        F.round("exp_baseline", 2).alias("exp_baseline"),
    )


@query(f"""WITH {SQL_CUSTOMER_YEAR}, {SQL_DIM}
SELECT cy.entity, period, income_group,
  round(avg(ln(num / orders)) OVER (PARTITION BY income_group), 6) AS baseline,
  round(avg(num / orders) OVER (PARTITION BY income_group), 2) AS exp_baseline
FROM cy JOIN customer ON cy.entity = c_custkey JOIN dim ON dim.entity = c_nationkey
WHERE period BETWEEN 1996 AND 2000 AND income_group IS NOT NULL""")
def income_baseline(spark, sf):
    df = kept(_customers_by_group(spark, sf, (1996, 2000)))
    out = baseline_by_group(
        df, "income_group", "index_log", period="period", years=(1996, 2000), drop_null_group=True
    )
    return out.select(
        "entity", "period", "income_group", F.round("baseline", 6).alias("baseline"),
        F.round("exp_baseline", 2).alias("exp_baseline"),
    )


def _customers_by_group(spark, sf, years=None):
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("entity")
    )
    groups = attach_dim(customers, nation_dim(spark, sf), "entity").drop("entity")
    panel = build_ratio_index(customer_year(spark, sf, years=years), "num", "orders")
    return panel.join(groups, panel["entity"] == groups["customer"]).drop("customer")


@query(f"""WITH {SQL_NATION_YEAR}, {SQL_DIM}
SELECT region, period, round(avg(index_log), 6) AS baseline, round(avg(exp(index_log)), 2) AS exp_baseline
FROM panel LEFT JOIN dim ON panel.entity = dim.entity GROUP BY 1, 2""")
def region_year_baseline(spark, sf):
    rows = attach_dim(index_panel(spark, sf), nation_dim(spark, sf), "entity")
    table = baseline_by_group(rows, ["region", "period"], "index_log", collapse=True)
    return table.select(
        "region", "period", F.round("baseline", 6).alias("baseline"), F.round("exp_baseline", 2).alias("exp_baseline")
    )


@query(f"""WITH {SQL_CUSTOMER_YEAR}, {SQL_DIM},
b AS (SELECT income_group, avg(ln(num / orders)) OVER (PARTITION BY income_group) AS baseline
      FROM cy JOIN customer ON cy.entity = c_custkey JOIN dim ON dim.entity = c_nationkey)
SELECT income_group, round(min(baseline), 6) AS ymin, round(max(baseline), 6) AS ymax
FROM b WHERE income_group IS NOT NULL GROUP BY income_group""")
def income_bounds(spark, sf):
    rows = baseline_by_group(kept(_customers_by_group(spark, sf)), "income_group", "index_log")
    return group_bounds(rows, "income_group", "baseline").select(
        "income_group", F.round("ymin", 6).alias("ymin"), F.round("ymax", 6).alias("ymax")
    )


@query("""WITH m AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period,
  sum(o_totalprice) AS num FROM orders GROUP BY 1, 2)
SELECT entity, period, round(num, 2) AS num,
       round(lag(num, 5) OVER (PARTITION BY entity ORDER BY period), 2) AS num_lag FROM m""")
def lag5(spark, sf):
    monthly = kept(customer_year(spark, sf, period=month_key()).select("entity", "period", "num"))
    return lag_rows(monthly, "entity", "period", "num", 5).select(
        "entity", "period", F.round("num", 2).alias("num"), F.round("num_lag", 2).alias("num_lag")
    )


@query(f"""WITH {SQL_NATION_YEAR}
SELECT round(avg(index_log), 6) AS mean_log, round(avg(num), 2) AS mean_num, avg(den) AS mean_den
FROM panel WHERE entity = 7 AND period = 1998""")
def snapshot(spark, sf):
    one = entity_snapshot(
        index_panel(spark, sf, (1998, 1998)), "entity", 7, "period", 1998,
        {"index_log": "mean_log", "num": "mean_num", "den": "mean_den"},
    )
    return one.select(F.round("mean_log", 6).alias("mean_log"), F.round("mean_num", 2).alias("mean_num"), "mean_den")


@query(f"""WITH {SQL_CUSTOMER_YEAR},
i AS (SELECT entity, ln(num / orders) AS v FROM cy WHERE period = 1998),
m AS (SELECT avg(v) AS mean FROM i)
SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
  (SELECT entity FROM i ORDER BY v DESC, entity LIMIT 1) AS highest,
  (SELECT entity FROM i ORDER BY v, entity LIMIT 1) AS lowest,
  count(*) FILTER (WHERE v > (SELECT mean FROM m)) AS n_above, count(DISTINCT entity) AS n_entities FROM i""")
def key_index_figures(spark, sf):
    df = kept(build_ratio_index(customer_year(spark, sf, years=(1998, 1998)), "num", "orders"))
    return key_figures(df, "index_log", "entity").select(
        F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
        "highest", "lowest", "n_above", "n_entities",
    )


@query("""SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders""")
def index_mean_sd(spark, sf):
    return describe_index(load(spark, sf, "orders"), "o_totalprice").select(
        F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")
    )


@query("""SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS highest,
       (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS lowest""")
def extreme_orders(spark, sf):
    return extreme_entity(load(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@query("""SELECT count(*) AS n_above FROM lineitem
WHERE l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem)""")
def rows_above_mean(spark, sf):
    return count_above(load(spark, sf, "lineitem"), "l_extendedprice")


# --- distribution tables ---------------------------------------------------------------

def _five(col: str, source: str) -> str:
    q = ", ".join(
        f"round(quantile_cont({col}, {p}), 6) AS {n}"
        for p, n in ((0.0, '"min"'), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, '"max"'))
    )
    return f"""SELECT '{col}' AS "column", {q}, round(avg({col}), 6) AS mean,
  count(*) FILTER (WHERE {col} IS NULL) AS n_null FROM {source}"""


@query(f"""WITH src AS (SELECT l_quantity, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price,
  l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)
{_five('l_quantity', 'src')} UNION ALL {_five('price', 'src')} UNION ALL {_five('revenue', 'src')}""")
def five_number(spark, sf):
    df = load(spark, sf, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    table = summary_table(df, ["l_quantity", "price", "revenue"])
    return table.select(
        "column", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")], "n_null"
    )


def _histogram_sql(source: str, col: str, bins: str) -> str:
    """Edges on the 1-2-5 grid, bins closed on the right."""
    return f"""WITH v AS (SELECT {col} AS v FROM {source} WHERE {col} IS NOT NULL),
b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, (max(v) - min(v)) / {bins} AS w FROM v),
u AS (SELECT *, pow(10.0, floor(log10(w))) AS u FROM b),
s AS (SELECT *, CASE WHEN 2 * u - w < 1.5 * (w - u) THEN
        CASE WHEN 5 * u - w < 2.75 * (w - 2 * u) THEN
          CASE WHEN 10 * u - w < 1.5 * (w - 5 * u) THEN 10 * u ELSE 5 * u END ELSE 2 * u END ELSE u END AS step FROM u),
e AS (SELECT *, CAST(floor(lo / step + 1e-7) AS BIGINT) AS f, CAST(ceil(hi / step - 1e-7) AS BIGINT) AS l FROM s),
g AS (SELECT CAST(i AS INTEGER) AS bin, (f + i - 1) * step AS lower, (f + i) * step AS upper, n, step
      FROM e, range(1, 1000) AS r(i) WHERE i <= l - f),
edges AS (SELECT list(g.upper + 1e-7 * g.step ORDER BY g.bin) AS ups FROM g),
c AS (SELECT CAST(least(len(ups), 1 + len(list_filter(ups, lambda u: u < v))) AS INTEGER) AS bin, count(*) AS k
      FROM v, edges GROUP BY 1)
SELECT g.bin, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(k, 0) AS count,
       round(coalesce(k, 0) / (n * step), 10) AS density FROM g LEFT JOIN c ON g.bin = c.bin"""


def _histogram(table):
    return table.select(
        "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count",
        F.round("density", 10).alias("density"),
    )


@query(_histogram_sql("(SELECT ln(o_totalprice) AS x FROM orders)", "x", "20"))
def histogram(spark, sf):
    df = load(spark, sf, "orders").select(log_of("o_totalprice").alias("x"))
    return _histogram(histogram_table(df, "x", 20))


@query(_histogram_sql("events", "value", "ceil(log2(count(*)) + 1)"))
def histogram_default(spark, sf):
    return _histogram(histogram_table(load(spark, sf, "events"), "value", None))


@query(_histogram_sql("lineitem", "l_discount", "20"))
def histogram_edges(spark, sf):
    """Values that lie on the edges."""
    return _histogram(histogram_table(load(spark, sf, "lineitem").select("l_discount"), "l_discount", 20))


@query("""WITH s AS (SELECT min(ln(o_totalprice)) AS lo, max(ln(o_totalprice)) AS hi, avg(ln(o_totalprice)) AS m,
  stddev_samp(ln(o_totalprice)) AS s FROM orders),
g AS (SELECT CAST(p AS INTEGER) AS point, lo + (hi - lo) * (p - 1) / 87 AS x, m, s FROM s, range(1, 89) AS r(p))
SELECT point, round(x, 8) AS x, round(exp(-0.5 * pow((x - m) / s, 2)) / (s * sqrt(2 * pi())), 8) AS density FROM g""")
def normal_curve(spark, sf):
    df = load(spark, sf, "orders").select(log_of("o_totalprice").alias("v"))
    return normal_density(df, "v").select("point", F.round("x", 8).alias("x"), F.round("density", 8).alias("density"))


@query("""SELECT event_id, round(exp(-0.5 * pow((value - m) / s, 2)) / (s * sqrt(2 * pi())), 10) AS density
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")
def density_rows(spark, sf):
    return density_column(load(spark, sf, "events"), "value").select(
        "event_id", F.round("density", 10).alias("density")
    )


@query(f"""WITH {SQL_LINES}
SELECT o_orderkey, round(ln(q * q), 8) AS x, round(ln(o_totalprice), 8) AS y
FROM orders JOIN lines ON l_orderkey = o_orderkey""")
def scatter(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rows = orders.join(order_terms(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = scatter_table(rows, log_square("q"), log_of("o_totalprice"), carry=["o_orderkey"])
    return pairs.select("o_orderkey", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"""WITH {SQL_NATION_YEAR}
SELECT entity, period, round(index_log, 6) AS index_log, round(avg(index_log) OVER (), 6) AS overall
FROM panel WHERE period BETWEEN 1996 AND 2000""")
def overall_mean(spark, sf):
    df = kept(period_between(index_panel(spark, sf, (1996, 2000)), "period", 1996, 2000))
    return df.select(
        "entity", "period", F.round("index_log", 6).alias("index_log"),
        F.round(df.agg(F.avg("index_log")).scalar(), 6).alias("overall"),
    )


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer""")
def entity_names(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", normal_name(F.col("c_name")).alias("name"))


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split(" + _PLAIN + ", ' '), lambda w: w NOT IN ('', 'of', 'state')))"


@query(f"""WITH raw AS (
  SELECT CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'Greater ' || n_name WHEN 2 THEN n_nationkey || ' nation (State of)'
              WHEN 3 THEN 'Nation' ELSE c_mktsegment END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT name, count(*) AS n_rows FROM raw GROUP BY name),
named AS (SELECT name, {_PLAIN.format("name")} AS plain, {_WORDS.format("name")} AS own FROM counts),
known AS (SELECT n_nationkey AS code, {_PLAIN.format("n_name")} AS plain, {_WORDS.format("n_name")} AS words FROM nation),
pairs AS (
  SELECT name, code, CASE WHEN named.plain = known.plain THEN 0 WHEN len(own) = len(words) THEN 1000
                          ELSE 2000 + abs(len(own) - len(words)) END AS rule
  FROM named JOIN known ON named.plain = known.plain OR list_has_all(own, words) OR list_has_all(words, own)),
best AS (SELECT name, min(rule) AS rule FROM pairs GROUP BY name),
hits AS (SELECT name, rule, count(DISTINCT code) AS n, min(code) AS code FROM pairs JOIN best USING (name, rule) GROUP BY 1, 2)
SELECT counts.name, n_rows, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN rule = 0 THEN 'exact'
         WHEN rule = 1000 THEN 'words' ELSE 'contained' END AS status,
       CASE WHEN n = 1 THEN code END AS code, CAST(coalesce(n, 0) AS INTEGER) AS n_candidates
FROM counts LEFT JOIN hits ON hits.name = counts.name""")
def resolve_by_words(spark, sf):
    """Spellings of nations that customers' rows use, against the nations' own names."""
    nation = load(spark, sf, "nation")
    rows = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 5
    name = (
        F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("Greater "), "n_name"))
        .when(kind == 2, F.concat(F.col("n_nationkey").cast("string"), F.lit(" nation (State of)")))
        .when(kind == 3, F.lit("Nation")).otherwise(F.col("c_mktsegment"))
    )
    found = match_names(rows.select(name.alias("name")), "name", nation, "n_name", "n_nationkey", ignore=["of", "state"])
    number = F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates"))
    return found.select("name", F.col("rows").alias("n_rows"), "status", "code", number.alias("n_candidates"))
