"""The panels the registered queries work on, as Spark plans and as SQL fragments.

Order rows are reduced to customer x year before anything else is joined: a customer
with very many orders then counts as a few rows, the number of distinct customers needs
no distinct count, and the join with ``customer`` moves reduced rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.numeric import log1p_square, log_of, ratio
from panelyard.operators.sizing import kept
from panelyard.session import fit_shuffles
from panelyard.sources.readers import read_table


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fit_shuffles(read_table(spark, f"{sf_dir}/{name}.parquet", TABLES[name]))


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity and discount per order."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d")
    )


def in_years(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Rows dated in the years first..last, as a range on the column itself, which the scan
    can use to skip data (a condition on year(date) cannot)."""
    kind = df.schema[date].dataType
    start, end = (F.lit(f"{y}-01-01").cast(kind) for y in (first, last + 1))
    return df.filter((F.col(date) >= start) & (F.col(date) < end))


def customer_year(
    spark: SparkSession, sf_dir: str, terms: bool = False, extra: tuple[str, ...] = (),
    period: Column | None = None, years: tuple[int, int] | None = None,
) -> DataFrame:
    """(entity = customer, period): num, orders and, with ``terms``, sums and counts of the order means."""
    source = load(spark, sf_dir, "orders")
    if years is not None:
        source = in_years(source, "o_orderdate", *years)
    orders = source.select(
        "o_orderkey",
        F.col("o_custkey").alias("entity"),
        (F.year("o_orderdate") if period is None else period).alias("period"),
        "o_totalprice",
        *extra,
    )
    stats = [F.sum("o_totalprice").alias("num"), F.count("*").alias("orders")]
    if terms:
        orders = orders.join(order_terms(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        for c in ("q", "d"):
            stats += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    return orders.groupBy("entity", "period", *extra).agg(*stats)


def nation_year(
    spark: SparkSession, sf_dir: str, terms: bool = False, extra: tuple[str, ...] = (),
    period: Column | None = None, years: tuple[int, int] | None = None,
) -> DataFrame:
    """(entity = nation, period): num, den = customers with an order, and x1, x2 with ``terms``."""
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation")
    )
    joined = customer_year(spark, sf_dir, terms, extra, period, years).join(customers, "entity")
    stats = [F.sum("num").alias("num"), F.count("*").alias("den")]
    if terms:
        stats += [
            (F.sum("q_sum") / F.sum("q_n")).alias("x1"),
            (F.sum("d_sum") / F.sum("d_n")).alias("x2"),
        ]
    return joined.groupBy(F.col("nation").alias("entity"), "period", *extra).agg(*stats)


def customer_cells(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """customer x year x priority with all sums: what both the panel and the scenario drivers
    are added up from, kept, so that orders and their lines are read once for both."""
    return kept(customer_year(spark, sf_dir, terms=True, extra=("o_orderpriority",), years=years))


def panel_of(cells: DataFrame) -> DataFrame:
    """The customer panel from its parts by priority."""
    sums = ("num", "orders", "q_sum", "q_n", "d_sum", "d_n")
    return _panel(cells.groupBy("entity", "period").agg(*[F.sum(c).alias(c) for c in sums]))


def customer_panel(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Unbalanced model panel: customer x year with y, a, b."""
    return _panel(customer_year(spark, sf_dir, terms=True, years=years))


def customer_index(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """The panel's response alone; the lines are not read."""
    return customer_year(spark, sf_dir, years=years).select("entity", "period", log_of(ratio("num", "orders")).alias("y"))


def _panel(sums: DataFrame) -> DataFrame:
    return sums.select(
        "entity",
        "period",
        log_of(ratio("num", "orders")).alias("y"),
        log_of(ratio("q_sum", "q_n")).alias("a"),
        log1p_square(ratio("d_sum", "d_n")).alias("b"),
    )


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced model panel: nation x year with y, a, b."""
    return nation_year(spark, sf_dir, terms=True).select(
        "entity",
        "period",
        log_of(ratio("num", "den")).alias("y"),
        log_of("x1").alias("a"),
        log1p_square("x2").alias("b"),
    )


def index_panel(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """nation x year with the log ratio index."""
    return nation_year(spark, sf_dir, years=years).withColumn("index_log", log_of(ratio("num", "den")))


def nation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> name, region, income group, development class; some nations have no region."""
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    income = F.array(
        F.lit("High income"), F.lit("Low income"), F.lit("Lower middle income"), F.lit("Upper middle income")
    )
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        key.alias("entity"),
        "n_name",
        F.when(key % 11 != 0, F.col("r_name")).alias("region"),
        F.when(key % 7 != 0, income[key % 4]).alias("income_group"),
        F.when(key % 3 == 0, "Developed").otherwise("Developing").alias("classification"),
    )


def month_key() -> Column:
    """Months since year 0, so that consecutive months are consecutive integers."""
    return F.year("o_orderdate") * 12 + F.month("o_orderdate")


# The same panels in SQL.

SQL_LINES = """lines AS (
  SELECT l_orderkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY l_orderkey)"""

SQL_CUSTOMER_YEAR = """cy AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
         sum(o_totalprice) AS num, count(*) AS orders
  FROM orders GROUP BY 1, 2)"""

SQL_NATION_YEAR = """panel AS (
  SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
         sum(o_totalprice) AS num, count(DISTINCT o_custkey) AS den,
         ln(sum(o_totalprice) / count(DISTINCT o_custkey)) AS index_log
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

SQL_NATION_TERMS = SQL_LINES + """, panel AS (
  SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
         sum(o_totalprice) AS num, count(DISTINCT o_custkey) AS den, avg(q) AS x1, avg(d) AS x2
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON l_orderkey = o_orderkey
  GROUP BY 1, 2)"""

SQL_CUSTOMER_PANEL = SQL_LINES + """, raw AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
         avg(o_totalprice) AS ratio, avg(q) AS x1, avg(d) AS x2
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY 1, 2),
frame AS (
  SELECT entity, period, CASE WHEN ratio > 0 THEN ln(ratio) END AS y,
         CASE WHEN x1 > 0 THEN ln(x1) END AS a, ln(1 + x2 * x2) AS b FROM raw),
full_frame AS (SELECT * FROM frame WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)"""

SQL_NATION_PANEL = SQL_NATION_TERMS + """,
frame AS (
  SELECT entity, period, ln(num / den) AS y, ln(x1) AS a, ln(1 + x2 * x2) AS b FROM panel),
full_frame AS (SELECT * FROM frame WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)"""

SQL_DIM = """dim AS (
  SELECT n_nationkey AS entity, n_name,
         CASE WHEN n_nationkey % 11 <> 0 THEN r_name END AS region,
         CASE WHEN n_nationkey % 7 <> 0 THEN
           CASE n_nationkey % 4 WHEN 0 THEN 'High income' WHEN 1 THEN 'Low income'
                WHEN 2 THEN 'Lower middle income' ELSE 'Upper middle income' END END AS income_group,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Developed' ELSE 'Developing' END AS classification
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
