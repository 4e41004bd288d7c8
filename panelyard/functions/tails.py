"""Upper tails of the chi-square, t and F distributions on numpy arrays.

Used on coefficient-sized results, and inside one Arrow UDF for one-row-per-entity
p-values. Both incomplete functions are evaluated by their standard series and
continued fraction (modified Lentz).
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_STEPS = 1_000_000   # never needed: past it the result is NaN, not an unfinished one
_LARGE = 1e4         # from here on a degree of freedom is treated as nearly infinite


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                return max(0.0, 1.0 - total * scale)
        return math.nan
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for n in range(1, _STEPS):
        step = -n * (n - a)
        b += 2
        d = 1 / (step * d + b or _TINY)
        c = b + step / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            return scale * h
    return math.nan


def _log_gamma_gain(a: float, b: float) -> float:
    """log gamma(a + b) - log gamma(a); for large a by Stirling's series, whose large parts
    cancel here on paper."""
    if a < _LARGE:
        return math.lgamma(a + b) - math.lgamma(a)
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + series(a + b) - series(a)


def _beta_i(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta I_x(a, b), where y = 1 - x is given without rounding."""
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    if a >= _LARGE > b:
        return _beta_large(a, b, x, y)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, y, x) if b < _LARGE or a >= _LARGE else 1.0 - _beta_large_lower(b, a, y, x)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    small, large = min(a, b), max(a, b)
    front = math.exp(_log_gamma_gain(large, small) - math.lgamma(small) + a * log_x + b * log_y) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _STEPS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d or _TINY)
            c = 1 + step / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h
    return math.nan


def _beta_large_lower(b: float, a: float, y: float, x: float) -> float:
    """I_y(b, a) for a large a and small a * y: a series of positive terms."""
    term = total = 1.0
    for n in range(_STEPS):
        term *= (a + b + n) / (b + 1 + n) * y
        total += term
        if term < total * 1e-17:
            log_front = _log_gamma_gain(a, b) - math.lgamma(b + 1) + a * math.log1p(-y) + b * math.log(y)
            return math.exp(log_front) * total
    return math.nan


def _beta_large(a: float, b: float, x: float, y: float) -> float:
    """I_x(a, b) for a large a, x near 1: the tail of nearly a gamma variable. Above its mean by
    a continued fraction in a * y - b * x, which keeps the digits that 1 - x would lose."""
    excess = a * y - b * x
    if excess <= 1:
        return 1.0 - _beta_large_lower(b, a, y, x)

    def denominator(m: int) -> float:
        return m + m * (b - m) * x / (a + 2 * m - 1) + (a + m) * (excess + 1 + m * (1 + y)) / (a + 2 * m + 1)

    h = denominator(0) or _TINY
    c, d = h, 0.0
    for m in range(1, _STEPS):
        step = (a + m - 1) * (a + b + m - 1) * m * (b - m) * x * x / (a + 2 * m - 1) ** 2
        below = denominator(m)
        d = 1 / (below + step * d or _TINY)
        c = below + step / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            log_front = _log_gamma_gain(a, b) - math.lgamma(b) + a * math.log1p(-y) + b * math.log(y)
            return math.exp(log_front) / h
    return math.nan


def _map(fn, *args) -> np.ndarray:
    arrays = np.broadcast_arrays(*(np.asarray(a, dtype=float) for a in args))
    out = np.full(arrays[0].shape, np.nan)
    for i in np.ndindex(out.shape):
        row = [a[i] for a in arrays]
        if not any(math.isnan(v) for v in row):
            out[i] = fn(*row)
    return out


def chi2_tail(stat, df) -> np.ndarray:
    """P(X > stat), X ~ chi-square(df)."""

    def one(s, k):
        return math.erfc(math.sqrt(max(s, 0.0) / 2)) if k == 1 else _gamma_q(k / 2, s / 2)

    return _map(one, stat, df)


def t_tail(stat, df) -> np.ndarray:
    """P(|T| > |stat|), T ~ t(df)."""
    return _map(lambda s, v: _beta_i(v / 2, 0.5, v / (v + s * s), s * s / (v + s * s)) if v > 0 else math.nan, stat, df)


def f_tail(stat, df1, df2) -> np.ndarray:
    """P(F > stat), F ~ F(df1, df2)."""
    return _map(
        lambda s, v1, v2: _beta_i(v2 / 2, v1 / 2, v2 / (v2 + v1 * s), v1 * s / (v2 + v1 * s)) if v2 > 0 and s >= 0 else math.nan if v2 <= 0 else 1.0,
        stat, df1, df2,
    )


def normal_tail(stat) -> np.ndarray:
    """P(|Z| > |stat|)."""
    return _map(lambda s: math.erfc(abs(s) / math.sqrt(2)), stat)
