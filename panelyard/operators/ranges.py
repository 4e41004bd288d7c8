"""Rows in a total order, dealt to numbered ranges.

A range exchange puts rows in order over tasks without gathering them; the number of the task a
row landed in is kept with it. Figures of whole ranges (counts, minima) are then one row per
range, and what an ordered computation needs from other ranges is carried by those. No cut point
ever reaches the driver or the plan, so ranges may be as many as the rows need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.sizing import kept

SLACK = 2   # ranges for each share of rows: sampled limits leave some ranges larger than others


def range_count(rows: int, most: int) -> int:
    """Ranges so that none holds much more than ``most`` / SLACK rows; one if all fit."""
    return 1 if rows <= most else SLACK * math.ceil(rows / most)


def numbered_ranges(df: DataFrame, order: Sequence[Column], ranges: int, out: str = "_range") -> DataFrame:
    """``df`` with the number of each row's range; ranges follow ``order``. The result is kept, so
    that all that is computed from it sees the same ranges; a lost part is made anew by the
    limits that were found first. Rows equal in ``order`` stay together: end it with a column that
    tells them apart where they may be many."""
    if ranges <= 1:
        return df.withColumn(out, F.lit(0))
    return kept(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()))
