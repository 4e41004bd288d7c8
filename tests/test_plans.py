"""Plan shapes that have to hold whatever the data size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from panelyard import session
from panelyard.operators import sizing
from panelyard.operators.baseline import with_group_stats
from panelyard.operators.columns import minmax
from panelyard.operators.filters import period_grid
from panelyard.operators.models import fit_within
from panelyard.operators.reshape import pivot_mean
from panelyard.plans.catalog import QUERIES
from panelyard.plans.panels import customer_year, load
from panelyard.plans.queries_prep import scenario_baseline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_scan_reads_only_the_needed_columns(spark):
    text = plan(customer_year(spark, SF))
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:\w+>", text)


def test_period_filters_reach_the_scan(spark):
    parts = load(spark, SF, "part").select("p_partkey", "p_size")
    assert "GreaterThanOrEqual(p_size,10)" in plan(period_grid(parts, "p_size", 10, 40, 5))


def test_year_ranges_reach_the_scan(spark):
    out = plan(customer_year(spark, SF, years=(1996, 2000)))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate,1996-01-01.*LessThan\(o_orderdate,2001-01-01", out)


def test_group_stats_use_no_window(spark):
    rows = load(spark, SF, "orders").select("o_custkey", "o_totalprice")
    out = plan(with_group_stats(rows, "o_custkey", {"m": F.avg("o_totalprice")}))
    assert "Window" not in out and "BroadcastHashJoin" in out
    main = out.split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in main   # the rows themselves are not shuffled


def test_milestones_are_one_aggregate(spark):
    rows = customer_year(spark, SF)
    assert plan(pivot_mean(rows, ["entity"], "period", "num", [1995, 1998])).count("\nHashAggregate") <= plan(
        rows.groupBy("entity").agg(F.avg("num"))
    ).count("\nHashAggregate")


def test_own_bounds_come_from_a_scalar_subquery(spark):
    out = plan(minmax(load(spark, SF, "orders").select("o_totalprice"), "o_totalprice"))
    assert "Subquery" in out and "Join" not in out


def test_no_cross_join_in_the_flagship_query(spark):
    out = plan(scenario_baseline(spark, SF))
    assert "CartesianProduct" not in out and "NestedLoop" not in out


def test_within_fit_needs_one_shuffle_by_entity(spark):
    rows = load(spark, SF, "orders").select(
        F.col("o_custkey").alias("entity"), F.ln("o_totalprice").alias("y"), F.year("o_orderdate").alias("x")
    )
    fit = fit_within(rows, "y", ["x"], "entity")
    out = plan(fit.moments)
    assert len(re.findall(r"Exchange hashpartitioning|hashpartitioning\(entity", out)) >= 1
    assert out.count("SortMergeJoin") == 0 and "Window" not in out


def test_shuffles_follow_the_input_size(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    orders = session.fit_shuffles(load(spark, SF, "orders"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(session, "SHUFFLE_SHARE", 1000)
    try:
        session.fit_shuffles(orders)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 30
    finally:
        session.tune(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("name", ["pct_change", "band", "fitted_bands", "scenario_projection"])
def test_projection_reads_lines_and_orders_once(spark, name):
    spark.catalog.clearCache()
    text = plan(QUERIES[name](spark, SF))
    for table in ("lineitem", "orders"):
        # The plan of a kept table is printed wherever it is used; its scans differ in schema.
        read = re.findall(rf"/{table}\.parquet\][^R]*(?:PushedFilters: [^\n]*)?\s*ReadSchema: ([^\n]*)", text)
        assert len(set(read)) == 1, (table, set(read))


@pytest.mark.parametrize("name,first,after", [
    ("anchored_intercepts", 1998, 1999), ("class_baseline", 1998, 2001), ("income_baseline", 1996, 2001), ("group_mean_years", 1996, 2001),
])
def test_year_ranges_of_queries_reach_the_scan(spark, name, first, after):
    spark.catalog.clearCache()
    text = plan(QUERIES[name](spark, SF))
    assert re.search(rf"GreaterThanOrEqual\(o_orderdate,{first}-01-01[^\n]*LessThan\(o_orderdate,{after}-01-01", text)
    assert ("lineitem.parquet" in text) == (name == "anchored_intercepts")


def test_kept_tables_can_be_released(spark):
    rows = load(spark, SF, "orders").select("o_custkey", "o_totalprice")
    out = with_group_stats(rows, "o_custkey", {"m": F.avg("o_totalprice")})
    n = out.count()
    sizing.release()
    assert out.count() == n and sizing._KEPT == []


def test_shuffles_follow_sources_not_joins(spark, tmp_path):
    """The planner's size of a join is a product; the partitions follow what is read."""
    from panelyard.session import SHUFFLE_SHARE, fit_shuffles, source_bytes, table_bytes, tune

    spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS x").write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    joined = one.join(one.withColumnsRenamed({"x": "y"}), "id")
    assert source_bytes(one) == table_bytes(one) and source_bytes(joined) == 2 * source_bytes(one)
    assert table_bytes(joined) > 100 * SHUFFLE_SHARE
    before = spark.conf.get("spark.sql.shuffle.partitions")
    fit_shuffles(joined)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    tune(spark)
