"""Chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.filters import exclude, exclude_where
from panelyard.operators.joins import choropleth_table, cutoff_grid

__all__ = ["band_table", "choropleth_table", "cutoff_lines"]


def band_table(
    summary: DataFrame,
    group: str,
    scenario: str = "scenario",
    period: str = "year",
    out: str = "index",
    after: int | None = None,
    leave_out: Sequence[str] = (),
    only: Sequence[str] = (),
    scale: str = "log",
) -> DataFrame:
    """Line and band of a collapsed summary: fit, lwr, upr per (group, scenario, period),
    periods after ``after``."""
    prefix = out if scale == "log" else f"exp_{out}"
    rows = summary if after is None else summary.filter(F.col(period) > after)
    if leave_out:
        rows = exclude(rows, scenario, leave_out)
    if only:
        rows = rows.filter(F.col(scenario).isin(list(only)))
    return rows.select(
        group, scenario, period, *[F.col(f"{prefix}_{k}").alias(k) for k in ("fit", "lwr", "upr")]
    )


def cutoff_lines(
    groups: DataFrame,
    cutoffs: Sequence[tuple[str, float]],
    hidden: Sequence[tuple[Sequence[str], str]] = (),
    group: str = "region",
    name: str = "income_group",
) -> DataFrame:
    """Cutoff lines per group; ``hidden`` lists (groups, cutoff name) pairs left out."""
    grid = cutoff_grid(groups, cutoffs, name)
    unwanted = F.lit(False)
    for members, label in hidden:
        unwanted = unwanted | (F.col(group).isin(list(members)) & (F.col(name) == label))
    return exclude_where(grid, unwanted)
