"""Registered queries of the readers' steps on text lines made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.plans.panels import customer_year, load
from panelyard.plans.registry import query
from panelyard.session import table_bytes
from panelyard.sources.readers import drop_repeated_headers, parse_lines, read_csv_checked, read_csv_skip, skip_preamble
from panelyard.sources.sinks import shared_path, store_panel, write_table

FILE_BYTES = 64 * 1024**2   # of source for each text file or bucket written


@query("""SELECT upper(substr(n_name, 1, 3)) AS code, n_name AS name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE regexp_full_match(upper(substr(n_name, 1, 3)), '[A-Z]{3}')""")
def lookup_lines(spark, sf):
    """A lookup with its header line repeated in every region, parsed back."""
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    body = rows.select(F.concat_ws(",", F.upper(F.substring("n_name", 1, 3)), F.concat(F.lit('"'), "n_name", F.lit('"')), "r_name").alias("value"))
    headers = region.select(F.lit("code,name,region").alias("value"))
    return drop_repeated_headers(parse_lines(body.unionAll(headers), "code string, name string, region string"), "code")


@query("SELECT o_orderkey AS key, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def preamble_lines(spark, sf):
    """Every order as a line behind four preamble lines and a header, per priority, parsed back."""
    orders = load(spark, sf, "orders")
    body = orders.select(
        F.concat_ws(",", "o_orderkey", "o_totalprice", "o_orderpriority").alias("value"), (F.col("o_orderkey") + 5).alias("position")
    )
    files = orders.select("o_orderpriority").distinct()
    head = files.select(F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("position")).select(
        F.when(F.col("position") == 4, "key,price,priority").when(F.col("position") == 1, "").otherwise('"Data Source","x"').alias("value"), "position"
    )
    return parse_lines(skip_preamble(body.unionByName(head), 4), "key bigint, price double, priority string")


def _text_files(spark, sf, price) -> str:
    """Every order as a CSV line in files that open with two preamble lines and a header; the path."""
    orders = load(spark, sf, "orders")
    files = max(8, table_bytes(orders) // FILE_BYTES)
    note = F.concat(F.lit('"'), "o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, "\nsecond line").otherwise(""), F.lit('"'))
    body = orders.select(
        F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("file"), F.lit(3).alias("turn"), F.col("o_orderkey").alias("place"),
        F.concat_ws(",", "o_orderkey", price, note).alias("value"),
    )
    head = spark.range(files).select(
        F.col("id").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"), F.lit(0).cast("long").alias("place")
    ).withColumn("value", F.when(F.col("turn") == 2, "key,price,note").otherwise('Data Source,"x"'))
    path = shared_path(spark, "lines")
    body.unionByName(head).repartition(int(files), "file").sortWithinPartitions("file", "turn", "place").select("file", "value").write.partitionBy(
        "file"
    ).text(path)
    return path


@query("SELECT o_orderkey AS key, o_totalprice AS price, o_orderpriority AS note FROM orders WHERE o_orderkey % 11 <> 0")
def csv_preamble_files(spark, sf):
    """Files with a preamble, written and read back; notes of two lines are left out."""
    one_line = load(spark, sf, "orders").filter(F.col("o_orderkey") % 11 != 0)
    files = max(8, table_bytes(one_line) // FILE_BYTES)
    lines = one_line.select(
        F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("file"), F.lit(1).alias("turn"), F.concat_ws(",", "o_orderkey", "o_totalprice", "o_orderpriority").alias("value")
    )
    head = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("turn"), F.lit('"Data Source","x"\n\nkey,price,note').alias("value"))
    path = shared_path(spark, "lines")
    lines.unionByName(head).repartition(int(files), "file").sortWithinPartitions("file", "turn").select("file", "value").write.partitionBy("file").text(path)
    return read_csv_skip(spark, path, 2, "key bigint, price double, note string")


@query("""SELECT 'good' AS kind, o_orderkey AS key, o_totalprice AS price,
  o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN chr(10) || 'second line' ELSE '' END AS note, NULL AS record FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT 'broken', NULL, NULL, NULL,
  o_orderkey || ',n/a,"' || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN chr(10) || 'second line' ELSE '' END || '"' FROM orders WHERE o_orderkey % 97 = 0""")
def csv_quarantine(spark, sf):
    """Records over several lines behind a preamble; those that do not fit come as a table of their own."""
    price = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    good, broken = read_csv_checked(spark, _text_files(spark, sf, price), "key bigint, price double, note string", skip=2, several_lines=True)
    return good.select(F.lit("good").alias("kind"), "*", F.lit(None).cast("string").alias("record")).unionByName(
        broken.select(F.lit("broken").alias("kind"), "record"), allowMissingColumns=True
    )


@query("""WITH p AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, sum(o_totalprice) AS num, count(*) AS orders FROM orders GROUP BY 1, 2)
SELECT entity, round(sum(num), 2) AS total, round(avg(orders), 6) AS mean_orders, count(*) AS periods FROM p GROUP BY entity""")
def stored_panels(spark, sf):
    """Two panels written bucketed by entity, joined and averaged by entity without an exchange."""
    panel = customer_year(spark, sf)
    buckets = int(max(8, table_bytes(load(spark, sf, "orders")) // FILE_BYTES))
    values = store_panel(panel.select("entity", "period", "num"), ["entity"], buckets)
    counts = store_panel(panel.select("entity", "period", "orders"), ["entity"], buckets)
    return stored_means(values, counts)


def stored_means(values, counts):
    """Total, mean number of orders and periods of each entity from two panels."""
    joined = values.hint("merge").join(counts, ["entity", "period"])
    return joined.groupBy("entity").agg(
        F.round(F.sum("num"), 2).alias("total"), F.round(F.avg("orders"), 6).alias("mean_orders"), F.count("*").alias("periods")
    )


@query("SELECT c_custkey AS entity, round(c_acctbal, 2) AS balance, c_mktsegment AS segment FROM customer")
def sink_round_trip(spark, sf):
    """A result table through the sink, by segment, and read again."""
    path = shared_path(spark, "result")
    customer = load(spark, sf, "customer")
    write_table(customer.select(F.col("c_custkey").alias("entity"), F.round("c_acctbal", 2).alias("balance"), F.col("c_mktsegment").alias("segment")), path, partition_by=["segment"])
    return spark.read.schema("entity bigint, balance double, segment string").parquet(path)
