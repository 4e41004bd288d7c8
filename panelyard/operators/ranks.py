"""Positions of values in a total order, without sorting everything in one task.

Values are first reduced to distinct values with counts. Those go into numbered ranges, are
ordered inside each range, and shifted by the row count of the ranges below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.ranges import numbered_ranges, range_count
from panelyard.operators.sizing import kept, null_safe_join

BLOCK_ROWS = 200_000


def cumulative_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    weight: str | None = None,
) -> tuple[DataFrame, int, int]:
    """Each distinct non-NULL value per ``by`` group: its count ``cnt``, and ``cum``, the
    number of rows at or below it. ``block`` is kept for ordered work across blocks.
    ``weight`` names a column of counts for rows that stand for several. Also returns the
    number of non-NULL rows and of blocks."""
    by = list(by)
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count("*")).alias("cnt")
    )
    values = kept(values)
    distinct, total = values.agg(F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0))).first()
    blocks = range_count(distinct, block_rows)
    values = numbered_ranges(values, [F.col(c) for c in (*by, value)], blocks, "block")
    inside = Window.partitionBy(*by, "block").orderBy(value)
    inner = values.withColumn("cum", F.sum("cnt").over(inside))
    if blocks == 1:
        return inner, total, 1
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        values.groupBy(*by, "block")
        .agg(F.sum("cnt").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    shifted = null_safe_join(inner, offsets, [*by, "block"]).withColumn("cum", F.col("cum") + F.col("_offset"))
    return shifted.drop("_offset"), total, blocks
