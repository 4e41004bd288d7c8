"""Joining per-group results back to rows without trusting the group sizes.

A grouped aggregate is small when there are few groups and huge when there are many,
and the planner cannot tell which before it has run. ``measured`` runs it once, keeps
the (already reduced) result, and so gives the planner its true size: a small one is
then broadcast by Spark's own threshold, and the rows it is joined to are not shuffled.
A large one is joined by shuffle, and a key with more rows than one task should hold is
spread over as many salts as it has such shares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.session import size_in_bytes, table_bytes

ROWS_PER_TASK = 1_000_000   # a key with more rows is hot and gets a salt for each such share
HOT_KEYS = 100_000          # up to so many hot keys their list is broadcast


_KEPT: list[DataFrame] = []


@contextmanager
def scope() -> Iterator[None]:
    """Give back, at its end, the tables kept inside: for results that are computed there."""
    start = len(_KEPT)
    try:
        yield
    finally:
        while len(_KEPT) > start:
            _KEPT.pop().unpersist()


def kept(table: DataFrame) -> DataFrame:
    """Keep a reduced table in executor memory or disk until ``release``."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(table)
    return table


def release() -> None:
    """Give back every table the operators kept. Results already built stay valid: what
    they still need is computed again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def measured(table: DataFrame) -> tuple[DataFrame, int]:
    """Run a reduced table once and keep it; returns it with its row count."""
    table = kept(table)
    return table, table.count()


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the left keys are kept."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the planner will broadcast a kept table, by its measured size."""
    limit = table.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return table_bytes(table) <= size_in_bytes(limit)


def attach_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    small: bool | None = None,
) -> DataFrame:
    """Left-join one-row-per-group ``stats`` to ``rows``.

    ``weight`` names the column of ``stats`` with each group's number of rows. It is what
    finds the hot keys when ``stats`` is too large to be broadcast (``small`` overrides the
    measurement): there are never more than rows / ``rows_per_task`` of them, and their list is
    broadcast only if it is short.
    """
    keys = list(keys)
    out = [c for c in stats.columns if c not in keys]
    rows = rows.drop(*out)
    stats, _ = measured(stats)
    if weight is None or (fits_broadcast(stats) if small is None else small):
        return null_safe_join(rows, stats, keys)

    shares = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    hot, n_hot = measured(stats.filter(F.col(weight) > rows_per_task).select(*keys, shares.alias("_shares")))
    if not n_hot:
        return null_safe_join(rows, stats, keys)
    marked = null_safe_join(rows, F.broadcast(hot) if n_hot <= HOT_KEYS else hot, keys)
    spread = F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.col("_shares")).cast("int")
    salted_rows = marked.withColumn("_salt", F.coalesce(spread, F.lit(0)))
    salted_stats = stats.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > rows_per_task, shares - 1).otherwise(0)))
    )
    return null_safe_join(salted_rows, salted_stats, [*keys, "_salt"]).drop("_shares", "_salt")
