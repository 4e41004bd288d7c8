"""Row filters, with the NULL-keeping exclusions a panel needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import clean
from panelyard.operators.sizing import attach_stats


def period_between(df: DataFrame, period: str, lo: int, hi: int) -> DataFrame:
    return df.filter(F.col(period).between(lo, hi))


def period_grid(df: DataFrame, period: str, lo: int, hi: int, step: int) -> DataFrame:
    """Periods lo, lo + step, ... up to hi. The range part is pushed to the scan."""
    p = F.col(period)
    return df.filter(p.between(lo, hi) & (F.pmod(p - lo, F.lit(step)) == 0))


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop rows whose value is in the list; a NULL value is not in the list and stays."""
    return df.filter(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def exclude_listed(df: DataFrame, col: str, listed: DataFrame) -> DataFrame:
    """``exclude`` for a list that is itself a table: an anti join on its first column."""
    keys = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
    return df.join(keys, df[col] == keys["_listed"], "left_anti")


def exclude_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition holds; unknown (NULL) conditions keep the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def is_complete(cols: Sequence[str], df: DataFrame) -> Column:
    """No NULL and no NaN in any of the columns."""
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in cols:
        value = clean(c) if kinds[c] in ("double", "float") else F.col(c)
        ok = ok & value.isNotNull()
    return ok


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in the named columns, or in any column."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def keep_groups_with_data(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keep whole groups that hold at least one row complete in ``cols``."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count_if(is_complete(cols, df)).alias("_complete")
    )
    return attach_stats(df, stats, keys, weight="_rows").filter("_complete > 0").drop("_rows", "_complete")
