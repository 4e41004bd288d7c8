"""Whole-table figures and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.breaks import pretty_edges, sturges_bins
from panelyard.functions.numeric import clean, normal_pdf
from panelyard.operators.selection import exact_quantiles

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTILE_NAMES = ("min", "q1", "median", "q3", "max")


def describe_index(df: DataFrame, col: str) -> DataFrame:
    """Mean and sample standard deviation as one row."""
    v = clean(col)
    return df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def extreme_entity(df: DataFrame, col: str, key: str) -> DataFrame:
    """Entities with the highest and the lowest value; the smaller key wins a tie."""
    v = clean(col)
    known = df.filter(v.isNotNull())
    return known.agg(
        F.min(F.struct(-v, F.col(key).alias("key")))["key"].alias("highest"),
        F.min(F.struct(v, F.col(key).alias("key")))["key"].alias("lowest"),
    )


def count_above(df: DataFrame, col: str, threshold: float | None = None) -> DataFrame:
    """Rows above a threshold, by default the column's own mean."""
    v = clean(col)
    limit = F.lit(threshold) if threshold is not None else df.agg(F.avg(v)).scalar()
    return df.filter(v > limit).agg(F.count("*").alias("n_above"))


def key_figures(df: DataFrame, col: str, key: str) -> DataFrame:
    """Mean, sd, extreme entities, rows above the mean and number of entities, as one row."""
    v = clean(col)
    mean = df.agg(F.avg(v)).scalar()
    known = v.isNotNull()
    return df.agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(F.when(known, F.struct(-v, F.col(key).alias("key"))))["key"].alias("highest"),
        F.min(F.when(known, F.struct(v, F.col(key).alias("key"))))["key"].alias("lowest"),
        F.count_if(v > mean).alias("n_above"),
        F.count_distinct(key).alias("n_entities"),
    )


def summary_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact five-number summary, mean and NULL count, one row per column."""
    values = df.select(*[clean(F.col(c).cast("double")).alias(c) for c in cols])
    # One read for everything but the inner quantiles, and the passes of their selection.
    row = values.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.min(c).alias(f"min_{c}") for c in cols],
        *[F.max(c).alias(f"max_{c}") for c in cols],
        F.count("*").alias("n"),
    ).first()
    counts = {c: row[f"n_{c}"] for c in cols}
    inner = exact_quantiles(values, counts, QUARTILES[1:-1])
    rows = [(c, row[f"min_{c}"], *inner[c], row[f"max_{c}"], row[f"mean_{c}"], row["n"] - counts[c]) for c in cols]
    kinds = ", ".join(f"{name} double" for name in (*QUARTILE_NAMES, "mean"))
    return df.sparkSession.createDataFrame(rows, f"column string, {kinds}, n_null long")


def histogram_table(df: DataFrame, col: str, bins: int | None = 20) -> DataFrame:
    """Bins of a histogram: edges, count and density; empty bins are kept.

    Bins are closed on the right and the first one also on the left; every value is in one. ``bins`` is a target
    (``None``: by Sturges' rule); edges lie on a 1-2-5 grid.
    """
    values = df.select(clean(col).alias("v")).filter("v IS NOT NULL")
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        raise ValueError(f"{col} has no values")
    edges, width = pretty_edges(lo, hi, bins or sturges_bins(n))
    last = len(edges) - 1
    # Values within a ten-millionth of a step of an edge lie on it. The quotient only finds a
    # bin next to the right one; the edges themselves decide.
    on_edge = F.lit([e + 1e-7 * width for e in edges])
    near = F.least(F.lit(last), F.greatest(F.lit(1), F.ceil((F.col("v") - edges[0]) / width).cast("int")))
    index = (
        F.when((near > 1) & (F.col("v") <= F.element_at(on_edge, near)), near - 1)
        .when((near < last) & (F.col("v") > F.element_at(on_edge, near + 1)), near + 1)
        .otherwise(near)
    )
    counts = values.groupBy(index.alias("_bin")).agg(F.count("*").alias("_n"))
    grid = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]), 1)],
        "bin int, lower double, upper double",
    )
    count = F.coalesce("_n", F.lit(0))
    return grid.join(counts, F.col("bin") == F.col("_bin"), "left").select(
        "bin", "lower", "upper", count.alias("count"), (count / (n * width)).alias("density")
    )


def normal_density(df: DataFrame, col: str, points: int = 88) -> DataFrame:
    """The fitted normal curve on an even grid from the smallest to the largest value."""
    v = clean(col)
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("point"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("point") - 1) / (points - 1)
    return grid.select("point", x.alias("x"), normal_pdf(x, F.col("m"), F.col("s")).alias("density"))


def density_column(df: DataFrame, col: str, out: str = "density") -> DataFrame:
    """Each row's density under the normal fitted to the column."""
    v = clean(col)
    fitted = df.agg(F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))).scalar()
    return df.withColumn(out, normal_pdf(F.col(col), fitted["m"], fitted["s"]))
