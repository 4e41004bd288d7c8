"""Scalar column expressions with the panel NULL rules.

NULL means "undefined, leave out": a log of a non-positive number, a ratio over zero
and a number that does not parse are all NULL. ``strict=True`` keeps the IEEE values
(-Infinity, NaN) instead.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """NaN becomes NULL, so averages skip it."""
    c = _col(x)
    return F.when(~F.isnan(c), c)


def to_double(x) -> Column:
    """Tolerant cast: text that is no number, and NaN, become NULL."""
    return clean(_col(x).try_cast("double"))


def to_int(x) -> Column:
    return _col(x).try_cast("int")


def to_text(x) -> Column:
    return _col(x).cast("string")


def ratio(num, den) -> Column:
    """num / den, NULL when den is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def log_of(x, strict: bool = False) -> Column:
    c = _col(x).cast("double")
    if not strict:
        return F.ln(c)
    return (
        F.when(c > 0, F.ln(c))
        .when(c == 0, F.lit(float("-inf")))
        .when(c.isNotNull(), F.lit(float("nan")))
    )


def log1p_of(x, strict: bool = False) -> Column:
    c = _col(x).cast("double")
    if not strict:
        return F.log1p(c)
    return (
        F.when(c > -1, F.log1p(c))
        .when(c == -1, F.lit(float("-inf")))
        .when(c.isNotNull(), F.lit(float("nan")))
    )


def log_square(x) -> Column:
    """log(x^2), defined for every x but zero."""
    c = _col(x).cast("double")
    return F.ln(c * c)


def log1p_square(x) -> Column:
    c = _col(x).cast("double")
    return F.log1p(c * c)


def normal_pdf(x, mean, sd) -> Column:
    z = (_col(x) - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
