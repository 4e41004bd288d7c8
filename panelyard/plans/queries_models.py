"""Registered queries: regressions, specification tests and out-of-sample error.

The check SQL works from demeaned sums and Cramer's rule for two terms. Tail
probabilities come from closed forms or Simpson sums inside the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators.sizing import kept
from panelyard.functions.numeric import log_of
from panelyard.operators.crossval import assign_folds, cv_report, cv_rmse, make_folds
from panelyard.operators.diagnostics import bh_adjust, bp_test, bp_test_by, hausman
from panelyard.operators.filters import keep_groups_with_data
from panelyard.operators.models import (
    fit_between, fit_ols, fit_random, fit_within, normal_interval, variance_components,
)
from panelyard.operators.store import MomentStore
from panelyard.plans.panels import (
    SQL_CUSTOMER_PANEL, SQL_CUSTOMER_YEAR, SQL_NATION_PANEL,
    customer_panel, customer_year, load, month_key, nation_panel,
)
from panelyard.plans.registry import query
from panelyard.plans.settings import LEVEL_SLOPE, LEVEL_STD_ERROR
from panelyard.sources.sinks import shared_path

XS = ["a", "b"]


# --- pieces of check SQL ---------------------------------------------------------------

def sql_t_tail(t: str, df: str) -> str:
    """Two-sided t tail: one minus a Simpson sum of the density up to |t|."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    at = f"(abs({t}) * i / 2000.0)"
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    return (
        f"(1 - 2 * {density} * abs({t}) / 6000.0 * list_sum(list_transform(range(0, 2001), "
        f"lambda i: {weight} * pow(1 + {at} * {at} / {df}, -({df} + 1) / 2.0))))"
    )


def sql_erfc(z: str) -> str:
    """erfc(z), z >= 0, by the all-positive series of erf."""
    return (
        f"(1 - 2 / sqrt(pi()) * exp(-({z}) * ({z})) * list_sum(list_transform(range(0, 200), "
        f"lambda i: exp(2 * i * ln(2.0) + (2 * i + 1) * ln(greatest({z}, 1e-150)) + lgamma(i + 1.0) - lgamma(2 * i + 2.0)))))"
    )


SQL_WITHIN_SUMS = """mu AS (SELECT entity, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS t FROM full_frame GROUP BY entity),
dm AS (SELECT f.entity, f.period, y - my AS y, a - ma AS a, b - mb AS b FROM full_frame f JOIN mu ON f.entity = mu.entity),
s AS (SELECT sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS say, sum(b * y) AS sby,
             sum(y * y) AS syy, count(*) AS n, (SELECT count(*) FROM mu) AS g FROM dm)"""

SQL_SLOPES = """fit AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba,
  (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM s),
r AS (SELECT *, syy - ba * say - bb * sby AS ssr FROM fit)"""

SQL_POOLED_SUMS = """mu AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM {frame}),
dm AS (SELECT y - my AS y, a - ma AS a, b - mb AS b FROM {frame}, mu),
s AS (SELECT sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS say, sum(b * y) AS sby,
             sum(y * y) AS syy, count(*) AS n FROM dm)"""


def sql_table(df: str, intercept: bool) -> str:
    """Coefficient rows from the CTEs r (and mu with an intercept)."""
    det = "(saa * sbb - sab * sab)"
    rows = [
        f"SELECT 'a' AS term, ba AS est, sqrt(ssr / {df} * sbb / {det}) AS se, {df} AS df FROM r",
        f"SELECT 'b', bb, sqrt(ssr / {df} * saa / {det}), {df} FROM r",
    ]
    if intercept:
        rows.append(
            f"SELECT '(Intercept)', my - ba * ma - bb * mb, sqrt(ssr / {df} * (1.0 / n + "
            f"(ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / {det})), {df} FROM r, mu"
        )
    return "tab AS (" + " UNION ALL ".join(rows) + ")"


SQL_SUMMARY = f"""SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 6) AS statistic,
       round({sql_t_tail('(est / se)', 'df')}, 6) AS p_value FROM tab"""


def sql_statistics(model: str, n: str, groups: str, df: str) -> str:
    f = f"(((syy - ssr) / 2) / (ssr / {df}))"
    return f"""SELECT '{model}' AS model, {n} AS n_obs, {groups} AS n_entities, {df} AS df_resid, round(ssr, 6) AS ssr,
  round(syy, 6) AS tss, round(1 - ssr / syy, 8) AS r_squared, round(1 - (ssr / {df}) / (syy / ({n} - 1)), 8) AS adj_r_squared,
  round({f}, 6) AS f_statistic, round(pow(1 + 2 * {f} / {df}, -({df}) / 2.0), 6) AS f_p_value FROM r"""


def rounded(df, digits: int = 6, keep=()):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


def rounded_statistics(fit):
    df = fit.statistics()
    return df.select(*[
        F.round(c, 8 if "r_squared" in c else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


# --- regressions -----------------------------------------------------------------------

@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_POOLED_SUMS.format(frame='full_frame')}, {SQL_SLOPES},
{sql_table('(n - 3)', True)} {SQL_SUMMARY}""")
def ols(spark, sf):
    return rounded(fit_ols(customer_panel(spark, sf), "y", XS).summary())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_POOLED_SUMS.format(frame='full_frame')}, {SQL_SLOPES}
{sql_statistics('ols', 'n', 'NULL::BIGINT', '(n - 3)')}""")
def ols_statistics(spark, sf):
    return rounded_statistics(fit_ols(customer_panel(spark, sf), "y", XS))


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}, {sql_table('(n - g - 2)', False)} {SQL_SUMMARY}""")
def within(spark, sf):
    return rounded(fit_within(customer_panel(spark, sf), "y", XS, "entity").summary())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}
{sql_statistics('within', 'n', 'g', '(n - g - 2)')}""")
def within_statistics(spark, sf):
    return rounded_statistics(fit_within(customer_panel(spark, sf), "y", XS, "entity"))


SQL_TIME_WITHIN_SUMS = SQL_WITHIN_SUMS.replace("SELECT entity, avg(y)", "SELECT period, avg(y)").replace(
    "GROUP BY entity", "GROUP BY period").replace("f.entity = mu.entity", "f.period = mu.period")


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_TIME_WITHIN_SUMS}, {SQL_SLOPES}, {sql_table('(n - g - 2)', False)} {SQL_SUMMARY}""")
def within_time(spark, sf):
    return rounded(fit_within(customer_panel(spark, sf), "y", XS, "period").summary())


def _sql_between(key: str, source: str = SQL_CUSTOMER_PANEL) -> str:
    return f"""{source}, bt AS (SELECT {key}, avg(y) AS y, avg(a) AS a, avg(b) AS b FROM full_frame GROUP BY {key}),
{SQL_POOLED_SUMS.format(frame='bt')}, {SQL_SLOPES}"""


@query(f"""WITH {_sql_between('entity')}, {sql_table('(n - 3)', True)} {SQL_SUMMARY}""")
def between(spark, sf):
    return rounded(fit_between(customer_panel(spark, sf), "y", XS, "entity").summary())


@query(f"""WITH {_sql_between('entity')} {sql_statistics('between', 'n', 'n', '(n - 3)')}""")
def between_statistics(spark, sf):
    return rounded_statistics(fit_between(customer_panel(spark, sf), "y", XS, "entity"))


@query(f"""WITH {_sql_between('period')}, {sql_table('(n - 3)', True)} {SQL_SUMMARY}""")
def between_time(spark, sf):
    return rounded(fit_between(customer_panel(spark, sf), "y", XS, "period").summary())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}
SELECT entity, round(my - ba * ma - bb * mb, 6) AS fixed_effect FROM mu, r""")
def fixed_effects(spark, sf):
    return rounded(fit_within(customer_panel(spark, sf), "y", XS, "entity").fixed_effects())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}
SELECT dm.entity, dm.period, round(my + ba * dm.a + bb * dm.b, 6) AS fitted, round(dm.y - ba * dm.a - bb * dm.b, 6) AS residual
FROM dm JOIN mu ON dm.entity = mu.entity, r""")
def residuals(spark, sf):
    return rounded(fit_within(kept(customer_panel(spark, sf)), "y", XS, "entity").residuals(carry=["period"]))


@query(f"""WITH {_sql_between('entity')}
SELECT entity, round(my + ba * (a - ma) + bb * (b - mb), 6) AS fitted,
       round(y - my - ba * (a - ma) - bb * (b - mb), 6) AS residual FROM bt, mu, r""")
def between_residuals(spark, sf):
    return rounded(fit_between(customer_panel(spark, sf), "y", XS, "entity").residuals())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES},
g AS (SELECT entity, sum(a * (y - ba * a - bb * b)) AS ga, sum(b * (y - ba * a - bb * b)) AS gb
      FROM (SELECT dm.*, ba, bb FROM dm, r) GROUP BY entity),
m AS (SELECT sum(ga * ga) AS maa, sum(ga * gb) AS mab, sum(gb * gb) AS mbb FROM g),
i AS (SELECT *, sbb / (saa * sbb - sab * sab) AS iaa, -sab / (saa * sbb - sab * sab) AS iab,
             saa / (saa * sbb - sab * sab) AS ibb, n - g - 2 AS df FROM r, m),
tab AS (SELECT 'a' AS term, ba AS est, sqrt(iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb) AS se, df FROM i
  UNION ALL SELECT 'b', bb, sqrt(iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb), df FROM i) {SQL_SUMMARY}""")
def robust_errors(spark, sf):
    return rounded(fit_within(customer_panel(spark, sf), "y", XS, "entity").robust_table())


@query(f"""WITH {_sql_between('entity')}, c AS (SELECT count(DISTINCT entity) AS u FROM frame),
{sql_table('(u - 2)', True).replace('FROM r', 'FROM r, c')}
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error FROM tab""")
def entity_df_errors(spark, sf):
    panel = kept(customer_panel(spark, sf))   # counted, then fitted
    units = panel.agg(F.count_distinct("entity")).first()[0]
    return rounded(fit_between(panel, "y", XS, "entity").classic_se(units))


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}, {sql_table('(n - g - 2)', False)}
SELECT term, round(est, 6) AS estimate, round(est - 1.959963984540054 * se, 6) AS conf_low,
       round(est + 1.959963984540054 * se, 6) AS conf_high FROM tab""")
def confidence_intervals(spark, sf):
    tidy = fit_within(customer_panel(spark, sf), "y", XS, "entity").tidy()
    return rounded(tidy.select("term", "estimate", "conf_low", "conf_high"))


@query(f"""SELECT o_orderkey, round({LEVEL_SLOPE - 1.959963984540054 * LEVEL_STD_ERROR} * ln(o_totalprice), 8) AS low,
       round({LEVEL_SLOPE + 1.959963984540054 * LEVEL_STD_ERROR} * ln(o_totalprice), 8) AS high FROM orders""")
def typed_interval(spark, sf):
    low, high = normal_interval(LEVEL_SLOPE, LEVEL_STD_ERROR)
    x = log_of("o_totalprice")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.round(low * x, 8).alias("low"), F.round(high * x, 8).alias("high")
    )


# Random effects on one term: the response carries the customer's balance, so that
# customers do differ.
SQL_RANDOM = f"""{SQL_CUSTOMER_PANEL},
rf AS (SELECT entity, period, y + c_acctbal / 5000 AS y, a FROM full_frame JOIN customer ON entity = c_custkey),
mu AS (SELECT entity, avg(y) AS my, avg(a) AS ma, count(*) AS t FROM rf GROUP BY entity),
w AS (SELECT sum((a - ma) * (a - ma)) AS saa, sum((a - ma) * (y - my)) AS say, sum((y - my) * (y - my)) AS syy,
             count(*) AS n FROM rf JOIN mu ON rf.entity = mu.entity),
fe AS (SELECT *, say / saa AS bf, (SELECT count(*) FROM mu) AS g FROM w),
fe2 AS (SELECT *, (syy - bf * say) / (n - g - 1) AS se2, (syy - bf * say) / (n - g - 1) / saa AS vf FROM fe),
p AS (SELECT sum(t) AS p0, sum(t * ma) AS p1, sum(t * ma * ma) AS p2, sum(t * my) AS q0, sum(t * ma * my) AS q1,
             sum(t * my * my) AS q2, sum(t * t) AS r0, sum(t * t * ma) AS r1, sum(t * t * ma * ma) AS r2 FROM mu),
bw AS (SELECT *, (p0 * q1 - p1 * q0) / (p0 * p2 - p1 * p1) AS b1, (q0 * p2 - p1 * q1) / (p0 * p2 - p1 * p1) AS b0,
              (p2 * r0 - 2 * p1 * r1 + p0 * r2) / (p0 * p2 - p1 * p1) AS tr FROM p),
qb AS (SELECT sum(t * pow(my - b0 - b1 * ma, 2)) AS q FROM mu, bw),
vc AS (SELECT se2, greatest(0, (q - (g - 2) * se2) / (n - tr)) AS su2, bf, vf, n, g FROM fe2, bw, qb),
th AS (SELECT entity, my, ma, 1 - sqrt(se2 / (se2 + t * su2)) AS theta FROM mu, vc),
tr AS (SELECT 1 - theta AS c, a - theta * ma AS x, y - theta * my AS y FROM rf JOIN th ON rf.entity = th.entity),
ns AS (SELECT sum(c * c) AS cc, sum(c * x) AS cx, sum(x * x) AS xx, sum(c * y) AS cy, sum(x * y) AS xy,
              sum(y * y) AS yy, count(*) AS n FROM tr),
re AS (SELECT *, (cy * xx - xy * cx) / (cc * xx - cx * cx) AS k, (xy * cc - cy * cx) / (cc * xx - cx * cx) AS b FROM ns),
re2 AS (SELECT *, (yy - k * cy - b * xy) / (n - 2) AS s2 FROM re)"""


def random_panel(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal")
    return customer_panel(spark, sf).join(customers, "entity").withColumn(
        "y", F.col("y") + F.col("c_acctbal") / 5000
    )


@query(f"""WITH {SQL_RANDOM},
tab AS (SELECT '(Intercept)' AS term, k AS est, sqrt(s2 * xx / (cc * xx - cx * cx)) AS se FROM re2
  UNION ALL SELECT 'a', b, sqrt(s2 * cc / (cc * xx - cx * cx)) FROM re2)
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 6) AS statistic,
       round({sql_erfc('least(abs(est / se) / sqrt(2.0), 6)')}, 6) AS p_value FROM tab""")
def random_effects(spark, sf):
    return rounded(fit_random(random_panel(spark, sf), "y", ["a"], "entity").summary())


@query(f"""WITH {SQL_RANDOM} SELECT round(se2, 8) AS sigma2_e, round(su2, 8) AS sigma2_u FROM vc""")
def random_variances(spark, sf):
    return rounded(variance_components(fit_random(random_panel(spark, sf), "y", ["a"], "entity")), 8)


@query(f"""WITH {SQL_RANDOM},
h AS (SELECT abs(pow(bf - b, 2) / (vf - s2 * cc / (cc * xx - cx * cx))) AS stat,
             vf > s2 * cc / (cc * xx - cx * cx) AS proper, vc.n AS n FROM vc, re2)
SELECT 'hausman' AS test, round(stat, 5) AS statistic, 1 AS df, round({sql_erfc('sqrt(stat / 2)')}, 6) AS p_value,
       n AS n_obs, proper AS positive_definite FROM h""")
def hausman_test(spark, sf):
    panel = random_panel(spark, sf)
    fixed = fit_within(panel, "y", ["a"], "entity")
    table = hausman(fixed, fit_random(panel, "y", ["a"], "entity", fixed.moments))
    return table.select(
        "test", F.round("statistic", 5).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"),
        "n_obs", "positive_definite",
    )


# --- specification tests ---------------------------------------------------------------

def _sql_bp(studentize: bool) -> str:
    name, stat = (
        ("breusch_pagan_studentized", "n * ess / eyy") if studentize
        else ("breusch_pagan", "0.5 * ess / pow(ssr / n, 2)")
    )
    return f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_POOLED_SUMS.format(frame='full_frame')}, {SQL_SLOPES},
e AS (SELECT dm.a, dm.b, pow(dm.y - ba * dm.a - bb * dm.b, 2) AS e2 FROM dm, r),
em AS (SELECT avg(e2) AS me FROM e),
es AS (SELECT sum(a * (e2 - me)) AS ea, sum(b * (e2 - me)) AS eb, sum(pow(e2 - me, 2)) AS eyy FROM e, em),
x AS (SELECT n, ssr, eyy, (ea * (ea * sbb - eb * sab) + eb * (eb * saa - ea * sab)) / (saa * sbb - sab * sab) AS ess FROM r, es),
t AS (SELECT n, {stat} AS stat FROM x)
SELECT '{name}' AS test, round(stat, 6) AS statistic, 2 AS df, round(exp(-stat / 2), 6) AS p_value, n AS n_obs FROM t"""


@query(_sql_bp(True))
def bp_studentized(spark, sf):
    return rounded(bp_test(kept(customer_panel(spark, sf)), "y", XS))


@query(_sql_bp(False))
def bp_plain(spark, sf):
    return rounded(bp_test(kept(customer_panel(spark, sf)), "y", XS, studentize=False))


# Customer x month: log value against log number of orders a month holds, by nation.
SQL_MONTHS = """months AS (SELECT o_custkey AS customer, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period,
  sum(o_totalprice) AS num, count(*) AS orders FROM orders GROUP BY 1, 2),
nm AS (SELECT c_nationkey AS entity, period, CASE WHEN sum(num) > 300000 THEN ln(sum(num)) END AS y, ln(sum(orders)) AS x
  FROM months JOIN customer ON customer = c_custkey GROUP BY 1, 2),
bf AS (SELECT * FROM nm WHERE y IS NOT NULL AND x IS NOT NULL),
bl AS (SELECT entity, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(x) AS vx FROM bf GROUP BY entity),
be AS (SELECT bf.entity, x, pow(y - a - b * x, 2) AS e2 FROM bf JOIN bl ON bf.entity = bl.entity WHERE vx > 0),
bp AS (SELECT entity, count(*) AS n_obs, CASE WHEN count(*) >= 3 THEN count(*) * pow(corr(e2, x), 2) END AS stat
  FROM be GROUP BY entity)"""


def nation_months(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    months = customer_year(spark, sf, period=month_key()).join(customers, "entity")
    sums = months.groupBy(F.col("nation").alias("entity"), "period").agg(
        F.sum("num").alias("num"), F.sum("orders").alias("orders")
    )
    return sums.select(
        "entity", "period", F.when(F.col("num") > 300000, log_of("num")).alias("y"), log_of("orders").alias("x")
    )


@query(f"""WITH {SQL_MONTHS}
SELECT entity, n_obs, round(stat, 6) AS statistic, round({sql_erfc('sqrt(stat / 2)')}, 6) AS p_value FROM bp""")
def bp_by_entity(spark, sf):
    return rounded(bp_test_by(kept(nation_months(spark, sf)), "y", "x", "entity"))


@query(f"""WITH {SQL_MONTHS},
u AS (SELECT * FROM nm WHERE entity IN (SELECT entity FROM nm WHERE y IS NOT NULL AND x IS NOT NULL))
SELECT entity, count(*) AS rows, count(y) AS usable FROM u GROUP BY entity""")
def usable_entities(spark, sf):
    return keep_groups_with_data(kept(nation_months(spark, sf)), ["entity"], ["y", "x"]).groupBy("entity").agg(
        F.count("*").alias("rows"), F.count("y").alias("usable")
    )


# p-values over whole customers: customer-level statistics turned into two-sided tails.
@query(f"""WITH z AS (SELECT c_custkey AS entity, abs(c_acctbal - 4500) / 1000 AS z FROM customer),
p AS (SELECT entity, exp(-z * z / 2) AS p FROM z),
k AS (SELECT entity, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p)
SELECT entity, round(p, 10) AS p, round(least(1.0, min(m * p / r) OVER (ORDER BY p DESC)), 8) AS p_adjusted FROM k""")
def bh_adjusted(spark, sf):
    z = (F.col("c_acctbal") - 4500) / 1000
    tests = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.exp(-z * z / 2).alias("p")
    )
    return bh_adjust(kept(tests), "p").select("entity", F.round("p", 10).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted"))


@query(f"""WITH z AS (SELECT c_custkey AS entity, abs(c_acctbal - 4500) / 1000 AS z FROM customer WHERE c_custkey % 7 <> 0),
p AS (SELECT entity, exp(-z * z / 2) AS p FROM z),
k AS (SELECT entity, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p)
SELECT entity, round(p, 10) AS p, round(least(1.0, min(m * p / r) OVER (ORDER BY p DESC)), 8) AS p_adjusted FROM k
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 7 = 0""")
def bh_with_gaps(spark, sf):
    """Some customers without a p-value, half of those NaN."""
    z = (F.col("c_acctbal") - 4500) / 1000
    key = F.col("c_custkey")
    gap = F.when(key % 2 == 0, F.lit(float("nan")))
    tests = load(spark, sf, "customer").select(
        key.alias("entity"), F.when(key % 7 == 0, gap).otherwise(F.exp(-z * z / 2)).alias("p")
    )
    return bh_adjust(tests, "p").select(
        "entity", F.round(F.nanvl("p", F.lit(None).cast("double")), 10).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted")
    )


@query(f"""WITH {SQL_MONTHS},
p AS (SELECT entity, {sql_erfc('sqrt(stat / 2)')} AS p FROM bp WHERE stat IS NOT NULL),
k AS (SELECT entity, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p)
SELECT entity, round(p, 6) AS p_value, round(least(1.0, min(m * p / r) OVER (ORDER BY p DESC)), 6) AS p_adjusted FROM k""")
def bp_by_entity_adjusted(spark, sf):
    tests = bp_test_by(kept(nation_months(spark, sf)), "y", "x", "entity").filter("p_value IS NOT NULL")
    return rounded(bh_adjust(tests, "p_value").select("entity", "p_value", "p_adjusted"))


# --- out-of-sample error ---------------------------------------------------------------

SQL_FOLDS = """axis AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS period FROM orders),
num AS (SELECT period, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS total FROM axis),
folds AS (SELECT f.i AS fold, p.i - f.i + 1 AS pos, p.period FROM num f JOIN num p ON p.i BETWEEN f.i AND f.i + 4
  WHERE f.i <= f.total - 4),
spec AS (SELECT fold, min(period) AS lo, max(period) AS hi FROM folds GROUP BY fold)"""


@query(f"""WITH {SQL_FOLDS}, {SQL_CUSTOMER_YEAR}
SELECT CAST(fold AS INTEGER) AS fold, entity, cy.period, cy.period < lo OR cy.period > hi AS in_train,
       cy.period BETWEEN lo AND hi AS in_test FROM cy, spec""")
def cv_folds(spark, sf):
    panel = customer_year(spark, sf).select("entity", "period")
    return assign_folds(panel, make_folds(panel, "period"), "period").select(
        "fold", "entity", "period", "in_train", "in_test"
    )


def _sql_cv(fit_ctes: str) -> str:
    return f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_FOLDS}, {fit_ctes},
s AS (SELECT fold, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS say, sum(b * y) AS sby
      FROM dm GROUP BY fold),
fit AS (SELECT fold, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba,
  (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM s),
err AS (SELECT fit.fold, ba, bb, sqrt(avg(pow(y - ba * a - bb * b, 2)) FILTER (WHERE period < lo OR period > hi)) AS e_train,
  sqrt(avg(pow(y - ba * a - bb * b, 2)) FILTER (WHERE period BETWEEN lo AND hi)) AS e_test
  FROM full_frame, fit JOIN spec ON fit.fold = spec.fold GROUP BY 1, 2, 3),
cnt AS (SELECT fold, count(*) FILTER (WHERE period < lo OR period > hi) AS n_train,
  count(*) FILTER (WHERE period BETWEEN lo AND hi) AS n_test FROM frame, spec GROUP BY fold)"""


SQL_CV_WITHIN = _sql_cv("""tf AS (SELECT fold, full_frame.* FROM full_frame, spec WHERE period < lo OR period > hi),
dm AS (SELECT fold, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM tf
       WINDOW w AS (PARTITION BY fold, entity))""")

SQL_CV_BETWEEN = _sql_cv("""pm AS (SELECT period, avg(y) AS y, avg(a) AS a FROM full_frame GROUP BY period),
tf AS (SELECT fold, pm.* FROM pm, spec WHERE period < lo OR period > hi),
dm AS (SELECT fold, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, 0.0 AS b FROM tf
       WINDOW w AS (PARTITION BY fold))""").replace(
    "(say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba", "say / saa AS ba").replace(
    "(sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb", "0.0 AS bb")


@query(f"""{SQL_CV_WITHIN}
SELECT CAST(err.fold AS INTEGER) AS fold, n_train, n_test, 'ok' AS status, round(ba, 6) AS b_a, round(bb, 5) AS b_b,
       round(e_train, 6) AS rmse_train, round(e_test, 6) AS rmse_test FROM err JOIN cnt ON err.fold = cnt.fold""")
def cv_within(spark, sf):
    out = cv_rmse(kept(customer_panel(spark, sf)), "y", XS, "entity", "period")
    return rounded(out.withColumn("b_b", F.round("b_b", 5)))


@query(f"""{SQL_CV_WITHIN}
SELECT CAST(err.fold AS INTEGER) AS fold, n_train, n_test,
       CASE WHEN least(n_train, n_test) < 100000 THEN 'too_few_rows' ELSE 'ok' END AS status,
       CASE WHEN least(n_train, n_test) >= 100000 THEN round(e_train, 6) END AS rmse_train,
       CASE WHEN least(n_train, n_test) >= 100000 THEN round(e_test, 6) END AS rmse_test FROM err JOIN cnt ON err.fold = cnt.fold""")
def cv_guards(spark, sf):
    """Folds with fewer rows than asked for on a side have no errors."""
    out = cv_rmse(kept(customer_panel(spark, sf)), "y", XS, "entity", "period", min_rows=100_000)
    return rounded(out.drop("b_a", "b_b"))


@query(f"""{SQL_CV_BETWEEN}
SELECT CAST(err.fold AS INTEGER) AS fold, n_train, n_test, 'ok' AS status, round(ba, 6) AS b_a,
       round(e_train, 6) AS rmse_train, round(e_test, 6) AS rmse_test FROM err JOIN cnt ON err.fold = cnt.fold""")
def cv_between_time(spark, sf):
    return rounded(cv_rmse(kept(customer_panel(spark, sf)), "y", ["a"], "entity", "period", model="between_period", min_rows=1))


@query(f"""{SQL_CV_WITHIN}
SELECT count(*) AS folds_used, round(avg(e_train), 6) AS mean_rmse_train, round(avg(e_test), 6) AS mean_rmse_test,
       CASE WHEN avg(e_train) < avg(e_test) THEN 'train_better' WHEN avg(e_train) > avg(e_test) THEN 'test_better'
            ELSE 'equal' END AS verdict FROM err""")
def cv_verdict(spark, sf):
    return rounded(cv_report(cv_rmse(kept(customer_panel(spark, sf)), "y", XS, "entity", "period")))


# --- the balanced nation panel ---------------------------------------------------------

@query(f"""WITH {SQL_NATION_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}, {sql_table('(n - g - 2)', False)}
SELECT term, round(est, 4) AS estimate, round(se, 4) AS std_error FROM tab""")
def within_nations(spark, sf):
    table = fit_within(nation_panel(spark, sf), "y", XS, "entity").summary()
    return rounded(table.select("term", "estimate", "std_error"), 4)


# Level response on group means: mean price per order against the log mean quantity.
@query(f"""WITH {SQL_CUSTOMER_PANEL}, m AS (SELECT entity, avg(exp(y)) AS ratio, avg(a) AS a FROM full_frame GROUP BY entity)
SELECT '(Intercept)' AS term, round(regr_intercept(ratio, a), 4) AS estimate FROM m
UNION ALL SELECT 'a', round(regr_slope(ratio, a), 4) FROM m""")
def between_level(spark, sf):
    panel = customer_panel(spark, sf).na.drop("any").withColumn("ratio", F.exp("y"))
    return rounded(fit_between(panel, "ratio", ["a"], "entity").summary().select("term", "estimate"), 4)


# --- stored moments --------------------------------------------------------------------

def moment_store(spark, sf) -> MomentStore:
    """The customer panel's moments, added in two loads of years."""
    store = MomentStore(spark, shared_path(spark, "moments"), "y", XS, "entity", "period")
    for name, years in (("early", (1900, 1995)), ("late", (1996, 2100))):
        store.append(customer_panel(spark, sf, years), name)
    return MomentStore.open(spark, store.path)


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_WITHIN_SUMS}, {SQL_SLOPES}, {sql_table('(n - g - 2)', False)} {SQL_SUMMARY}""")
def store_within(spark, sf):
    return rounded(moment_store(spark, sf).within().summary())


@query(f"""WITH {SQL_CUSTOMER_PANEL}, {SQL_POOLED_SUMS.format(frame='full_frame')}, {SQL_SLOPES},
{sql_table('(n - 3)', True)} {SQL_SUMMARY}""")
def store_ols(spark, sf):
    return rounded(moment_store(spark, sf).ols().summary())


@query(f"""WITH {_sql_between('period')}, {sql_table('(n - 3)', True)} {SQL_SUMMARY}""")
def store_between_time(spark, sf):
    return rounded(moment_store(spark, sf).between("period").summary())


@query(f"""{SQL_CV_WITHIN}
SELECT CAST(err.fold AS INTEGER) AS fold, n_train, n_test, 'ok' AS status, round(ba, 6) AS b_a, round(bb, 5) AS b_b,
       round(e_train, 6) AS rmse_train, round(e_test, 6) AS rmse_test FROM err JOIN cnt ON err.fold = cnt.fold""")
def store_cv_within(spark, sf):
    out = moment_store(spark, sf).cv()
    return rounded(out.withColumn("b_b", F.round("b_b", 5)))
