"""Wide <-> long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import clean, to_int


def melt_years(
    df: DataFrame,
    ids: Sequence[str],
    year_cols: Sequence[str],
    value: str,
    period: str = "year",
    prefix: str = r"^\D+",
) -> DataFrame:
    """One row per (ids, year column), NULL cells included; the year is parsed from the label."""
    long = df.unpivot(list(ids), list(year_cols), "_label", value)
    return long.select(*ids, to_int(F.regexp_replace("_label", prefix, "")).alias(period), value)


def pivot_mean(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    value: str,
    periods: Sequence[int],
    prefix: str = "mean_",
) -> DataFrame:
    """One column per listed period with the mean of ``value`` there: a single grouped pass."""
    v = clean(value)
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(period) == p, v)).alias(f"{prefix}{p}") for p in periods]
    )
