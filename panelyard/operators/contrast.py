"""Milestone and contrast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.joins import attach_baseline
from panelyard.operators.reshape import pivot_mean
from panelyard.operators.sets import union_fill

MILESTONES = (2005, 2035, 2050, 2075, 2100)


def stack_milestones(
    proj: DataFrame, base: DataFrame, period: str, years: Sequence[int] = MILESTONES
) -> DataFrame:
    """Projections over baseline rows, milestone periods only."""
    wanted = F.col(period).isin(list(years))
    return union_fill(proj.filter(wanted), base.filter(wanted))


def milestone_means(
    stacked: DataFrame, keys: Sequence[str], period: str, value: str, years: Sequence[int]
) -> DataFrame:
    return pivot_mean(stacked, keys, period, value, years, "mean_proj_")


def pct_change_table(
    means: DataFrame, base: DataFrame, key: str, baseline: str, years: Sequence[int]
) -> DataFrame:
    """Percent change of every milestone mean against the group's baseline."""
    joined = attach_baseline(means, base, key, baseline)
    b = F.col(baseline)
    return joined.withColumns(
        {f"diff_{y}": F.try_divide(F.col(f"mean_proj_{y}") - b, b) * 100 for y in years}
    )


def factor_table(
    means: DataFrame, base: DataFrame, key: str, baseline: str, years: Sequence[int]
) -> DataFrame:
    """Every milestone mean as a multiple of the group's baseline."""
    joined = attach_baseline(means, base, key, baseline)
    return joined.withColumns(
        {f"factor_diff_{y}": F.try_divide(F.col(f"mean_proj_{y}"), F.col(baseline)) for y in years}
    )


def report_table(
    table: DataFrame,
    scenarios: Sequence[str],
    values: Sequence[str],
    keys: Sequence[str] = ("region", "scenario"),
    scenario: str = "scenario",
    digits: int = 2,
) -> DataFrame:
    """The chosen scenarios with rounded values."""
    return table.filter(F.col(scenario).isin(list(scenarios))).select(
        *[F.round(v, digits).alias(v) for v in values], *keys
    )
