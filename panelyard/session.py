"""Session settings the operators are designed around."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import DataFrame, SparkSession

# Run-time settings only, so they can be put on a session somebody else started.
RUNTIME_CONF = {
    # Re-plan joins and partition counts on measured shuffle sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where a grouping on the same key follows:
    # one more exchange costs less than one task holding a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Spark's own default, put back where stored panels were joined without an exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    base = spark.conf.get(_BASE, None)
    if base is not None:   # a query before raised it for its own tables
        spark.conf.set(_PARTITIONS, base)
        spark.conf.unset(_BASE)
    return spark


SHUFFLE_SHARE = 512 * 1024**2   # bytes of input files per shuffle partition
UNKNOWN = 1 << 60               # the planner's size of a table it knows nothing about is larger
_PARTITIONS = "spark.sql.shuffle.partitions"
_BASE = "panelyard.shuffle.partitions.base"   # the session's own setting while another is in force


def table_bytes(df: DataFrame) -> int:
    """The planner's size of a table: measured for files and kept tables. Where a session
    gives no access to its planner, an estimate from rows and columns."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001  (a remote session)
        return df.count() * 32 * len(df.columns)


def source_bytes(df: DataFrame) -> int:
    """The sizes of a table's sources added up. The planner's size of a join is the product of
    its sides, which says nothing of what will be shuffled."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001  (a remote session)
        return table_bytes(df)


def size_in_bytes(text: str) -> int:
    """A setting such as 10485760, 10485760b or 10m as a number; negative means none."""
    units = {"b": 1, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4}
    found = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", text.strip().lower())
    return int(found[1]) * units[found[2] or "b"]


def fit_shuffles(df: DataFrame) -> DataFrame:
    """Raise the number of shuffle partitions to the size of a table's sources, so that no
    partition outgrows an executor; adaptive execution merges those that turn out small.
    ``tune``, called before a query, puts the session's own setting back."""
    spark = df.sparkSession
    size = source_bytes(df)
    if size >= UNKNOWN:
        return df
    wanted = math.ceil(size / SHUFFLE_SHARE)
    now = spark.conf.get(_PARTITIONS)
    if wanted > int(now):
        if spark.conf.get(_BASE, None) is None:
            spark.conf.set(_BASE, now)
        spark.conf.set(_PARTITIONS, str(wanted))
    return df


def build_session(
    app: str = "panelyard", cpus: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own and call ``tune``."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs a few JVM calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
