"""Grouped statistics kept on rows, baselines and lags.

A grouped mean that keeps every row is an aggregate (combined before its shuffle) joined
back, not a window: a window would put each whole group into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.numeric import clean
from panelyard.operators.ranges import numbered_ranges, range_count
from panelyard.operators.sizing import attach_stats, null_safe_join

WINDOW_ROWS = 5_000_000   # rows of one entity a single sorted task may hold


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_group_stats(df: DataFrame, keys: str | Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add one column per grouped aggregate, keeping every row (NULL keys are a group)."""
    keys = _keys(keys)
    table = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[c.alias(name) for name, c in stats.items()]
    )
    return attach_stats(df, table, keys, weight="_rows").drop("_rows")


def baseline_average(
    df: DataFrame,
    entity: str | Sequence[str],
    period: str,
    cols: Mapping[str, str],
    years: tuple[int, int],
    at: int,
) -> DataFrame:
    """Rows of the reference period with each entity's mean over the window ``years``.

    ``cols`` maps a measure to the name of its mean.
    """
    keys = _keys(entity)
    window = df.filter(F.col(period).between(*years))
    means = window.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[F.avg(clean(c)).alias(out) for c, out in cols.items()]
    )
    return attach_stats(window.filter(F.col(period) == at), means, keys, weight="_rows").drop("_rows")


def baseline_by_group(
    df: DataFrame,
    group: str | Sequence[str],
    col: str,
    out: str = "baseline",
    period: str | None = None,
    years: tuple[int, int] | None = None,
    collapse: bool = False,
    drop_null_group: bool = False,
) -> DataFrame:
    """Group mean of a log index (``out``) and of its level (``exp_out``), on every row or
    one row per group."""
    if years is not None:
        df = df.filter(F.col(period).between(*years))
    keys = _keys(group)
    if drop_null_group:
        df = df.na.drop("any", subset=keys)
    value = clean(col)
    stats = {out: F.avg(value), f"exp_{out}": F.avg(F.exp(value))}
    if collapse:
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return with_group_stats(df, keys, stats)


def group_bounds(df: DataFrame, group: str, col: str) -> DataFrame:
    """Smallest and largest value per known group."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.min(clean(col)).alias("ymin"), F.max(clean(col)).alias("ymax"))
    )


def entity_snapshot(df: DataFrame, entity: str, value, period: str, at: int, cols: Mapping[str, str]) -> DataFrame:
    """Means of one entity in one period, as one row."""
    return df.filter((F.col(entity) == value) & (F.col(period) == at)).agg(
        *[F.avg(clean(c)).alias(out) for c, out in cols.items()]
    )


def lag_rows(
    df: DataFrame,
    entity: str,
    period: str,
    col: str,
    n: int,
    out: str | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """The value ``n`` rows earlier within the entity, in period order (rows, not periods).

    Periods of any orderable type; NULL periods come last. Rows of one (entity, period) are
    ordered by the value and then by their other columns. Where an entity has more than
    ``window_rows`` rows, all rows go into numbered ranges by entity, period and what orders rows
    of one period, so that a range may end anywhere within an entity, or within one of its periods.
    Inside a range this is a plain lag. Each range hands the last ``n`` rows of an entity on: its
    first ``n`` rows of an entity look up their values there, by position in the entity.
    """
    out = out or f"{col}_lag"
    if n < 0:
        raise ValueError("n must not be negative")
    sizes = df.groupBy(entity).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    order = [F.col(period).asc_nulls_last(), F.col(col), F.xxhash64(*df.columns)]
    if largest <= window_rows:
        return df.withColumn(out, F.lag(col, n).over(Window.partitionBy(entity).orderBy(*order)))

    # The last column tells wholly equal rows apart, so that even those may go to several ranges.
    ranged = numbered_ranges(
        df.withColumn("_row", F.monotonically_increasing_id()), [F.col(entity), *order, F.col("_row")], range_count(total, window_rows)
    )
    before = Window.partitionBy(entity).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(entity, "_range").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_range", entity).orderBy(*order, F.col("_row"))
    placed = null_safe_join(ranged, sizes, [entity, "_range"]).withColumns(
        {"_rn": F.row_number().over(inside), out: F.lag(col, n).over(inside)}
    )
    position = F.col("_offset") + F.col("_rn")
    carried = (F.col("_rn") <= n) & (position > n)   # the value lies in a range before
    first = placed.filter(carried).drop(out).withColumn("_pos", position - n)
    halo = placed.filter(F.col("_rn") > F.col("_n") - n).select(entity, position.alias("_pos"), F.col(col).alias(out))
    looked_up = null_safe_join(first, halo, [entity, "_pos"]).drop("_pos")
    rest = placed.filter(~carried)
    return rest.unionByName(looked_up.select(*rest.columns)).drop("_range", "_row", "_n", "_offset", "_rn")
