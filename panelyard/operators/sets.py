"""Unions, distinct values and ordered categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_fill(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION ALL by name; a column one side lacks is NULL there."""
    return left.unionByName(right, allowMissingColumns=True)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def with_order_key(
    df: DataFrame, col: str, levels: Sequence[str], out: str | None = None, reverse: bool = False
) -> DataFrame:
    """Integer sort key of an ordered category, 1 for the first level; unknown values get NULL."""
    ranked = list(reversed(levels)) if reverse else list(levels)
    key = F.lit(None).cast("int")
    for i, level in reversed(list(enumerate(ranked, 1))):
        key = F.when(F.col(col) == level, i).otherwise(key)
    return df.withColumn(out or f"{col}_order", key)
