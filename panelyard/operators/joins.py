"""Left joins of panels and dimensions. None carries a broadcast hint: the planner sees
file sizes and, through adaptive execution, measured shuffle sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.sizing import measured, null_safe_join


def join_panel(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join of two panels on (entity, period)."""
    if null_safe:
        return null_safe_join(left, right, keys)
    return left.join(right, list(keys), "left")


def one_row_per_key(dim: DataFrame, key: str) -> DataFrame:
    """The dimension with a run-time error where a key has several rows. The check is a
    scalar subquery beside the join, so the join itself still sees the plain table: it can
    be broadcast by file size, and adaptive execution can split a skewed key."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    again = dim.groupBy(key).count().filter("count > 1").agg(F.min(name)).scalar()
    error = F.raise_error(F.concat(F.lit(f"several dimension rows for {key} = "), again))
    return dim.select(
        *[F.col(c) if c == key else F.when(again.isNull(), F.col(c)).otherwise(error).alias(c) for c in dim.columns]
    )


def attach_dim(
    df: DataFrame, dim: DataFrame, key: str, fanout: bool = False, null_safe: bool = False
) -> DataFrame:
    """Left join of a dimension. ``fanout=True`` lets an entity sit in several groups;
    otherwise a repeated key in the dimension is an error when the plan runs."""
    if not fanout:
        dim = one_row_per_key(dim, key)
    if null_safe:
        return null_safe_join(df, dim, [key])
    return df.join(dim, key, "left")


def attach_baseline(summary: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Attach a per-group baseline kept on many rows. The baseline is reduced to its
    distinct (key, value) pairs first, so the join does not multiply rows."""
    return null_safe_join(summary, base.select(key, value).distinct(), [key])


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def resolve_entity(
    df: DataFrame, name: str, aliases: DataFrame, alias: str = "alias", code: str = "countrycode"
) -> DataFrame:
    """Entity names to codes through an alias table; names it does not know get NULL."""
    known = aliases.select(normal_name(F.col(alias)).alias("_alias"), F.col(code)).distinct()
    known = one_row_per_key(known, "_alias")
    return df.join(known, normal_name(df[name]) == known["_alias"], "left").drop("_alias")


def unresolved_names(df: DataFrame, name: str, aliases: DataFrame, alias: str = "alias") -> DataFrame:
    """Names that the alias table does not know, with their number of rows."""
    known = aliases.select(normal_name(F.col(alias)).alias("_alias")).distinct()
    counts = df.groupBy(name).agg(F.count("*").alias("rows"))
    return counts.join(known, normal_name(counts[name]) == known["_alias"], "left_anti")


def choropleth_table(
    df: DataFrame, shapes: DataFrame, key: str, order: Sequence[str] = ("id", "order"), whole: bool = True
) -> DataFrame:
    """Every shape vertex with the value of its entity (NULL where there is none), in drawing
    order: of the whole table, or (``whole`` false) of the vertices of each shape only.

    The values, one row per entity (a second one is an error), are computed first; known to be
    small, they are broadcast, and the vertices are moved once only, by the sort.
    """
    values, _ = measured(one_row_per_key(df, key))
    drawn = shapes.join(values, key, "left")
    return drawn.orderBy(*order) if whole else drawn.repartition(order[0]).sortWithinPartitions(*order)


def cutoff_grid(
    groups: DataFrame, cutoffs: Sequence[tuple[str, float]], name: str = "income_group", value: str = "cutoff"
) -> DataFrame:
    """Every group with every (name, cutoff) parameter row."""
    rows = F.array(*[F.struct(F.lit(n).alias(name), F.lit(float(v)).alias(value)) for n, v in cutoffs])
    return groups.select("*", F.inline(rows))
