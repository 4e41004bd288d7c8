"""Exact order statistics by radix selection.

A double becomes a 64-bit key of the same order. Each pass counts one digit of the keys, for the
rows whose higher digits are those of a wanted rank; the counters say which digit the rank has and
how many rows lie below it. No value is kept and nothing is sorted: what a task emits and what reaches
the driver are at most COUNTERS counters for each wanted prefix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 20
HELD = 4_000_000   # counters a task holds before it adds up equal ones
COUNTERS = 1 << DIGIT
_SIGN = np.uint64(1 << 63)


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of doubles without NaN; the two zeros have one key."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def key_values(keys: np.ndarray) -> np.ndarray:
    """The doubles of such keys."""
    keys = np.asarray(keys, dtype=np.uint64)
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def _count_task(prefixes: Sequence[np.ndarray | None], above: int, below: int):
    """Rows of a task by the key's bits from ``below`` on, of those whose bits from ``above`` on are
    among the column's prefixes (None: of all)."""

    def counted(values: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        keys = order_keys(values.drop_null().to_numpy(zero_copy_only=False))
        if wanted is not None:
            high = keys >> np.uint64(above)
            at = np.minimum(np.searchsorted(wanted, high), max(0, len(wanted) - 1))
            keys = keys[wanted[at] == high] if len(wanted) else keys[:0]
        return np.unique(keys >> np.uint64(below), return_counts=True)

    def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells, n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        return cells[starts], np.add.reduceat(n, starts) if len(starts) else n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for _ in prefixes]
        size = 0
        for batch in batches:
            for i, wanted in enumerate(prefixes):
                held[i].append(counted(batch.column(i), wanted))
                size += len(held[i][-1][0])
            if size > HELD:
                held = [[together(parts)] for parts in held]
                size = 0
        for i, parts in enumerate(held):
            cells, n = together(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), i, dtype=np.int32)), pa.array(cells.view(np.int64)), pa.array(n)], ["column", "cell", "n"]
            )

    return task


def _counters(df: DataFrame, prefixes: Sequence[np.ndarray | None], above: int, below: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted cells and their counts for each column."""
    made = df.mapInArrow(_count_task(prefixes, above, below), "column int, cell long, n long")
    table = made.groupBy("column", "cell").agg(F.sum("n").alias("n")).toArrow()
    column, cell, n = (table.column(c).to_numpy() for c in ("column", "cell", "n"))
    out = []
    for i in range(len(prefixes)):
        own = column == i
        cells, counts = cell[own].astype(np.int64).view(np.uint64), n[own]
        order = np.argsort(cells)
        out.append((cells[order], counts[order]))
    return out


def select_ranks(df: DataFrame, ranks: Sequence[Sequence[int]]) -> list[dict[int, float]]:
    """For each column of ``df`` (doubles without NaN; NULLs take no part) the values at its
    0-based ``ranks`` among the column's values. Two to four passes: as soon as the rows of every
    wanted prefix are no more than COUNTERS, one pass counts all digits that are left."""
    bits, prefixes = 64, [None] * len(ranks)
    # For each wanted rank: the prefix found so far and the rank among the rows that have it.
    state = [{k: (0, k) for k in set(own)} for own in ranks]
    counts = [{} for _ in ranks]
    while bits > 0:
        most = max((counts[i].get(p, 0) for i, own in enumerate(state) for p, _ in own.values()), default=0)
        below = 0 if bits < 64 and most <= COUNTERS else max(0, bits - DIGIT)
        found = _counters(df, prefixes, bits, below)
        for i, (cells, n) in enumerate(found):
            parents = cells >> np.uint64(bits - below) if bits < 64 else np.zeros(len(cells), dtype=np.uint64)
            counts[i] = dict(zip(cells.tolist(), n.tolist()))
            for rank, (prefix, left) in state[i].items():
                own = np.flatnonzero(parents == np.uint64(prefix))
                up_to = np.cumsum(n[own])
                j = int(np.searchsorted(up_to, left, side="right"))
                state[i][rank] = (int(cells[own[j]]), left - int(up_to[j] - n[own[j]]))
            prefixes[i] = np.array(sorted({p for p, _ in state[i].values()}), dtype=np.uint64)
        bits = below
    return [{r: float(key_values(np.array([p], dtype=np.uint64))[0]) for r, (p, _) in own.items()} for own in state]


def exact_quantiles(df: DataFrame, counts: dict[str, int], points: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (position (n - 1) * p) of each column. ``df`` holds double
    columns without NaN, ``counts`` their numbers of non-NULL values."""
    at = {c: [(n - 1) * p for p in points] if n else [] for c, n in counts.items()}
    ranks = [sorted({k for h in at[c] for k in (math.floor(h), math.ceil(h))}) for c in counts]
    found = select_ranks(df.select(*counts), ranks) if any(ranks) else [{} for _ in ranks]
    out = {}
    for c, own in zip(counts, found):
        low, high = ([own[f(h)] for h in at[c]] for f in (math.floor, math.ceil))
        values = [a if a == b else a + (h - math.floor(h)) * (b - a) for h, a, b in zip(at[c], low, high)]
        out[c] = values or [None] * len(points)
    return out
