"""Result-table sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result table as CSV (with header) or Parquet."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (``spark.checkpoint.dir``); where that is unset
    and all runs on this machine, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelyard-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_panel(df: DataFrame, keys: Sequence[str], buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """Write a panel as a table bucketed and sorted by ``keys`` and return it as read back. Panels
    with the same keys and number of buckets are joined on the keys, and grouped by them, without
    an exchange, also with more join keys: for that the session's
    ``spark.sql.requireAllClusterKeysForCoPartition`` is set to false, until ``tune`` is called again.
    A bucket should fit a task: about one for each 100 MB of the panel. The name lives in the session's
    catalogue, the files under ``path``."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = name or f"panel_{uuid.uuid4().hex}"
    path = path or shared_path(spark, name)
    df.write.format("parquet").mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
