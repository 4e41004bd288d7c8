"""Operator 4, URL filters: a sort-merge range join, in DataFrame steps only.

The host's labels, reversed and each closed by a dot, and then the path make a key in which a
rule (host, path) is an interval: of all keys that begin with its own. Intervals of such rules
are nested or apart. A rule also fits subdomains, whose labels come before the path, so a URL is
looked up by those suffixes of its host that have as many labels as some rule's host.

Openings and closings of rules and the URLs' keys are sorted into ranges. The running sum of
openings less closings is the height of the stack of active rules; the rule on top at height h
is the last one opened at h. Both are carried from range to range by tables with a row for each
range (and height). Ranges also cut between rows of one key, so no key is too large for a task.

Defined results. A URL NULL or without ``://`` has an empty host and path and only meets rules
for the empty host. A-Z of the host are lower-cased, nothing else is; the port and user belong
to it as they stand. Of several fitting rules the longest text (host and path) wins, then the
longer host, then the smaller rule number. Rules with a NULL host or verdict are left out, a NULL
path is empty. No fitting rule: the default verdict, and ``rule`` NULL. Repeated rows come out as
often as they went in. Empty tables give empty results; without rules all get the default.
Columns other than key and URL play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.common import parts_for, stored
from panelyard.llm.registry import query

RANGE_ROWS = 250_000     # keys sorted by one task
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = url.substr(F.length(after) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise("")


def url_path(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = url.substr(F.length(after) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(labels: Column) -> Column:
    """Reversed labels, each closed by a dot."""
    return F.array_join(F.transform(F.reverse(labels), lambda x: F.concat(x, F.lit("."))), "")


def key_bytes(host: Column, path: Column) -> Column:
    """Host part, a byte that text never holds, path: in the order of bytes."""
    return F.concat(F.encode(host, "UTF-8"), F.lit(bytearray(b"\xfe")), F.encode(path, "UTF-8"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``. ``rules``: host, path, verdict."""
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"))
    place = [url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")]
    urls = stored(rows.distinct().select("id", "url", *place))

    given = rules.select(
        F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.col("verdict").cast("string").alias("verdict"),
    ).dropna()
    # Of rules with the same host and path one remains: equal texts can't both win.
    given = given.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    first = key_bytes(host_key(F.split("host", r"\.")), F.col("path"))
    opened = given.select(first.alias("key"), F.lit(1).alias("step"), rule.alias("rule"))
    # Text has no byte 0xFF: it closes the interval after every key that begins with it.
    closed = opened.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(opened.schema["rule"].dataType).alias("rule"))
    labels = F.split("host", r"\.")
    # Numbers of labels that rules' hosts have: all that can meet a rule, however long a host is.
    depths = sorted(r["d"] for r in given.select(F.size(labels).alias("d")).distinct().collect())
    suffix = F.explode(F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size("labels"))).alias("depth")
    points = urls.withColumn("labels", labels).select("id", "url", "labels", "path", suffix).select(
        key_bytes(host_key(F.expr("slice(labels, -depth, depth)")), F.col("path")).alias("key"),
        F.lit(0).alias("step"), F.lit(None).cast(opened.schema["rule"].dataType).alias("rule"), "id", "url",
    )
    events = points.unionByName(opened.unionByName(closed), allowMissingColumns=True)
    # Closings come before, openings after what ends there, and URLs last at their own key.
    turn = F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)
    # A hash decides between rows of one key, so that ranges can cut there; openings stay first.
    events = events.withColumn("turn", turn).withColumn("tie", F.when(F.col("step") == 0, F.xxhash64("id", "url")).otherwise(F.lit(-(1 << 63))))
    n = parts_for(urls.count(), max(1, range_rows // 4))
    ranged = events.repartitionByRange(n, "key", "turn", "tie")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()))

    order = [F.col("key"), F.col("turn"), F.col("tie")]
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)   # a row for each range
    sums = ranged.groupBy("range").agg(F.sum("step").alias("rise"))
    sums = sums.select("range", F.coalesce(F.sum("rise").over(earlier), F.lit(0)).alias("base"))
    placed = ranged.join(sums, "range").withColumn("height", F.col("base") + F.sum("step").over(before))
    # The last opening at each height: within the range, or else on the stack it starts with.
    left = placed.filter("step = 1").groupBy("range", "height").agg(F.max_by("rule", "key").alias("opened"))
    stack = sums.filter("base > 0").select("range", F.explode(F.sequence(F.lit(1).cast("long"), F.col("base"))).alias("height"), F.lit(0).alias("turn"))
    stack = stack.unionByName(left.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy("height").orderBy("range", "turn").rowsBetween(Window.unboundedPreceding, 0)
    stack = stack.withColumn("below", F.last("opened", ignorenulls=True).over(past)).filter("turn = 0").select("range", "height", "below")
    at_height = Window.partitionBy("range", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    topped = placed.withColumn("own", F.last("rule", ignorenulls=True).over(at_height)).filter("step = 0")
    best = topped.join(stack, ["range", "height"], "left").groupBy("id", "url").agg(F.max(F.coalesce("own", "below")).alias("own"))

    # Rows as they came, each with the verdict of its key and URL: one row on the other side.
    best = stored(best.filter("own is not null").select(F.col("id").alias("b_id"), F.col("url").alias("b_url"), "own"))
    found = rows.select("id", "url", *place).join(
        best, F.col("id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")), "left"
    )
    return found.select(
        F.col("id").alias(key), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit(default)).alias("verdict")
    )


RULES = [   # fixed values
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("""
WITH r(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), fits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.n = p.n AND f.place = 1
""")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
