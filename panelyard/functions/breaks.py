"""Histogram edges."""

from __future__ import annotations

import math


def pretty_edges(lo: float, hi: float, bins: int) -> tuple[list[float], float]:
    """Edges and their step. Equally spaced edges on a 1-2-5 grid covering [lo, hi], about ``bins`` intervals.

    A step of 2, 5 or 10 times the power of ten is taken once the exact width is past
    the fixed switch points below, which favour the larger step.
    """
    width = (hi - lo) / bins
    if width <= 0:
        width = max(abs(lo), 1.0) / bins
    unit = 10.0 ** math.floor(math.log10(width))
    step = unit
    # The switch point to step s after step p is s - bias * (width - p),
    # with bias 1.5 for 2 and 10, and 2.75 for 5.
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * unit - width < bias * (width - step):
            step = factor * unit
    first = math.floor(lo / step + 1e-7)
    last = math.ceil(hi / step - 1e-7)
    if last == first:
        last += 1
    return [i * step for i in range(first, last + 1)], step


def sturges_bins(n: int) -> int:
    """Default number of intervals for n values."""
    return math.ceil(math.log2(n) + 1) if n > 0 else 1
