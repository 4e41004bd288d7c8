"""Second moments of model variables, per group.

Variable 0 is the response, 1..k are the terms. For each group a row holds the count
``n``, means ``m0..mk`` and centred cross sums ``c0_0, c0_1, ...`` (i <= j). Spark's
covariance aggregates combine partial results by the pairwise update, so the centred
sums do not suffer cancellation and one grouped pass is enough; a group with very many
rows reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.linear import pairs
from panelyard.functions.numeric import clean
from panelyard.operators.sizing import attach_stats


def model_frame(df: DataFrame, y: str, xs: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Complete cases only: carried key columns, then v0 (response) and v1..vk (terms)."""
    names = [y, *xs]
    frame = df.select(*carry, *[clean(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    return frame.na.drop("any", subset=[f"v{i}" for i in range(len(names))])


def moment_columns(k: int, prefix: str = "v") -> list[Column]:
    rows = F.count(f"{prefix}0")
    cols = [rows.alias("n")]
    cols += [F.avg(f"{prefix}{i}").alias(f"m{i}") for i in range(k + 1)]
    for i, j in pairs(k):
        spread = F.var_pop(f"{prefix}{i}") if i == j else F.covar_pop(f"{prefix}{i}", f"{prefix}{j}")
        cols.append((spread * rows).alias(f"c{i}_{j}"))
    return cols


def group_moments(frame: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return frame.groupBy(*keys).agg(*moment_columns(k))


def read_cross(row, k: int, prefix: str = "c") -> np.ndarray:
    """The symmetric (k+1) x (k+1) matrix stored in a row."""
    out = np.empty((k + 1, k + 1))
    for i, j in pairs(k):
        out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"]
    return out


def read_means(row, k: int, prefix: str = "m") -> np.ndarray:
    return np.array([row[f"{prefix}{i}"] for i in range(k + 1)], dtype=float)


def sum_cross(k: int) -> list[Column]:
    return [F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs(k)]


def _centres(k: int) -> list[Column]:
    n = F.sum("n")
    return [n.alias("_n"), *[F.try_divide(F.sum(F.col("n") * F.col(f"m{i}")), n).alias(f"_m{i}") for i in range(k + 1)]]


def _around(k: int, centre: Sequence[Column]) -> list[Column]:
    """Cross sums of groups of rows, moved from each group's own means to ``centre``."""
    gap = [F.col(f"m{i}") - c for i, c in enumerate(centre)]
    return [
        F.sum(F.when(F.col("n") > 0, F.col(f"c{i}_{j}") + F.col("n") * gap[i] * gap[j])).alias(f"c{i}_{j}")
        for i, j in pairs(k)
    ]


def merge_moments(parts: DataFrame, keys: Sequence[str], k: int, sums: Sequence[str] = ()) -> DataFrame:
    """Moments of larger groups from those of their parts; ``sums`` are columns to add up as well.

    The means come first and the parts' own means are taken from them, so nothing large is
    subtracted after it was squared. A key with very many parts is spread by ``attach_stats``."""
    centre = parts.groupBy(*keys).agg(F.count("*").alias("_parts"), *_centres(k))
    placed = attach_stats(parts, centre, keys, weight="_parts")
    known = [F.max(f"_m{i}").alias(f"m{i}") for i in range(k + 1)]
    merged = placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), *known, *_around(k, [F.col(f"_m{i}") for i in range(k + 1)]), *[F.sum(c).alias(c) for c in sums]
    )
    return merged


def merged_row(parts: DataFrame, k: int):
    """The same for all parts together, as one row on the driver."""
    centre = parts.agg(*_centres(k)).first()
    if not centre["_n"]:
        raise ValueError("no complete rows")
    means = [F.lit(centre[f"_m{i}"]) for i in range(k + 1)]
    return parts.agg(F.sum("n").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(means)], *_around(k, means)).first()
