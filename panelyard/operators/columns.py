"""Projections, renames, casts and index columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import clean, log_of, ratio, to_double


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last``, both included."""
    names = df.columns
    lo, hi = names.index(first), names.index(last)
    if lo > hi:
        raise ValueError(f"{first} comes after {last}")
    return names[lo : hi + 1]


def columns_at(df: DataFrame, start: int, stop: int) -> list[str]:
    """Column names by 1-based position, both ends included."""
    return df.columns[start - 1 : stop]


def tolerant_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: to_double(c) for c in cols})


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: clean(c) for c in cols})


def tag(df: DataFrame, **values) -> DataFrame:
    """Constant columns, e.g. ``tag(df, scenario="Baseline")``."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def rescale(df: DataFrame, col: str, factor: float) -> DataFrame:
    return df.withColumn(col, F.col(col) * factor)


def build_ratio_index(
    df: DataFrame, num: str, den: str, out: str = "index", strict: bool = False
) -> DataFrame:
    """``out`` = num / den and ``out``_log = log(num / den)."""
    value = ratio(num, den)
    return df.withColumns({out: value, f"{out}_log": log_of(value, strict)})


def build_level_index(
    df: DataFrame, col: str, out: str = "index", strict: bool = False
) -> DataFrame:
    """``out`` = the measure itself and ``out``_log = its log."""
    return df.withColumns({out: F.col(col), f"{out}_log": log_of(col, strict)})


def minmax(
    df: DataFrame, col: str, lo: float | None = None, hi: float | None = None, out: str | None = None
) -> DataFrame:
    """(x - lo) / (hi - lo). Missing bounds are the column's own, from one scalar subquery."""
    if lo is None or hi is None:
        value = clean(col)
        bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        lo_c = bounds["lo"] if lo is None else F.lit(lo)
        hi_c = bounds["hi"] if hi is None else F.lit(hi)
    else:
        lo_c, hi_c = F.lit(lo), F.lit(hi)
    return df.withColumn(out or f"{col}_n", F.try_divide(F.col(col) - lo_c, hi_c - lo_c))


def add_terms(df: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """Model-term columns, name -> expression."""
    return df.withColumns(dict(terms))


def scatter_table(df: DataFrame, x: Column, y: Column, carry: Sequence[str] = ()) -> DataFrame:
    """The (x, y) pairs behind a scatter plot."""
    return df.select(*carry, x.alias("x"), y.alias("y"))
