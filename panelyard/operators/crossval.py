"""Out-of-sample error over folds of periods, all folds in one job.

A fold tests on its own periods and trains on the periods outside [first, last] of the
fold. Rows are never copied once per fold they train:

* rows become moments per (entity, period) and per period, once;
* a fold's training side is the periods before it joined with the periods after it, by the
  pairwise update, from running moments in both directions. Nothing is subtracted, so a level
  break or one unit on a larger scale does not cancel the rest;
* errors are those of residuals under the slopes of all rows, corrected by the difference of the
  fold's slopes: the large levels of the terms drop out before anything is squared.

What is ordered in one place is the time axis (one row per period), never the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.linear import pairs, solve
from panelyard.functions.moments import merge, outside
from panelyard.functions.numeric import clean
from panelyard.operators.moments import moment_columns
from panelyard.operators.ranks import cumulative_counts
from panelyard.operators.sizing import measured

ENTITY_CELLS = 2_000_000   # numbers of one dense block of entities x periods


def make_folds(df: DataFrame, period: str, width: int = 5) -> DataFrame:
    """Contiguous windows of ``width`` periods as rows (fold, pos, period). The distinct
    periods, the time axis, are numbered in blocks."""
    axis = df.select(F.col(period).cast("int").alias("period")).filter("period IS NOT NULL").distinct()
    placed, total, _ = cumulative_counts(axis, "period")
    numbered = placed.select("period", F.col("cum").cast("int").alias("i")).filter(F.lit(total >= width))
    first = F.greatest(F.lit(1), F.col("i") - width + 1)
    last = F.least(F.col("i"), F.lit(total - width + 1))
    return numbered.select("period", "i", F.explode(F.sequence(first, last)).alias("fold")).select(
        "fold", (F.col("i") - F.col("fold") + 1).alias("pos"), "period"
    )


def fold_roles(df: DataFrame, folds: DataFrame, period: str) -> DataFrame:
    """What each period is to each fold it belongs to: (fold, period, in_train, in_test). One row
    for each, so as large as folds times periods; ``fold_index`` says the same in a row per fold."""
    index, axis, members = fold_index(df, folds, period)
    count = index.select("fold", F.explode(F.filter(
        F.array(F.struct(F.lit(1).alias("a"), F.col("before").alias("b")), F.struct((F.col("after") + 1).alias("a"), F.col("n").alias("b"))),
        lambda s: s["a"] <= s["b"],
    )).alias("s"))
    train = count.select("fold", F.explode(F.sequence(F.col("s.a"), F.col("s.b"))).alias("i"), F.lit(True).alias("in_train"), F.lit(False).alias("in_test"))
    test = members.select("fold", "i", F.lit(False).alias("in_train"), F.lit(True).alias("in_test"))
    # A fold listed backwards may train on a period twice, and one may also be tested on.
    roles = train.union(test).groupBy("fold", "i").agg(F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test"))
    return roles.join(axis, "i").select("fold", "period", "in_train", "in_test")


def fold_index(df: DataFrame, folds: DataFrame, period: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds as intervals of the time axis. Three tables: (fold, before, after, n), where a fold
    trains on the periods 1 to ``before`` and ``after`` + 1 to ``n`` of the axis; the axis itself
    (i, period); and the test periods (fold, i). Limits are a fold's first and last listed period, in
    listed order. The axis' periods and all limits are sorted once, in numbered ranges, and the
    running count of periods at each limit is where it lies: memory goes with folds and periods, never
    with their product."""
    listed = folds.select("fold", "pos", F.col("period").cast("int").alias("period"))
    limits = listed.groupBy("fold").agg(F.min_by("period", "pos").alias("first"), F.max_by("period", "pos").alias("last"))
    on_axis = df.select(F.col(period).cast("int").alias("p"), F.lit(1).alias("w")).filter("p IS NOT NULL").distinct()
    every = on_axis.union(listed.select(F.col("period").alias("p"), F.lit(0).alias("w")).distinct())
    placed, n, _ = cumulative_counts(every, "p", weight="w")
    placed = placed.select(F.col("p").alias("period"), F.col("cum").cast("int").alias("i"), F.col("cnt").cast("int").alias("w"))
    start = placed.select(F.col("period").alias("first"), (F.col("i") - F.col("w")).alias("before"))
    end = placed.select(F.col("period").alias("last"), F.col("i").alias("after"))
    index = limits.join(start, "first").join(end, "last").select("fold", "before", "after", F.lit(int(n)).alias("n"))
    axis = placed.filter("w = 1").select("i", "period")
    return index, axis, listed.join(axis, "period").select("fold", "i").distinct()


def assign_folds(df: DataFrame, folds: DataFrame, period: str) -> DataFrame:
    """The rows of every fold, marked ``in_train`` / ``in_test``. This writes a row once per
    fold it belongs to; ``cv_rmse`` does not need it."""
    roles, _ = measured(fold_roles(df, folds, period).filter("in_train OR in_test"))
    return df.join(roles.withColumnRenamed("period", "_period"), F.col(period) == F.col("_period")).drop("_period")


def _names(k: int) -> list[str]:
    return ["n", *[f"m{i}" for i in range(k + 1)], *[f"c{i}_{j}" for i, j in pairs(k)]]


def _state(rows: np.ndarray, k: int):
    """(n, mean, cross) from rows of the columns in _names."""
    rows = np.nan_to_num(rows)
    cross = np.zeros((*rows.shape[:-1], k + 1, k + 1))
    for at, (i, j) in enumerate(pairs(k), k + 2):
        cross[..., i, j] = cross[..., j, i] = rows[..., at]
    return rows[..., 0], rows[..., 1:k + 2], cross


def _table(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """A small table (one row per period or fold) as numbers."""
    got = df.select(*[F.col(c).cast("double") for c in columns]).toArrow()
    return np.column_stack([got.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float).reshape(-1, len(columns))


class Folds:
    """Where the folds lie on the time axis."""

    def __init__(self, axis: np.ndarray, folds: DataFrame):
        listed = _table(folds, ["fold", "pos", "period"])
        listed = listed[np.lexsort((listed[:, 1], listed[:, 0]))]
        self.number = np.unique(listed[:, 0]).astype(int)
        groups = [listed[listed[:, 0] == f, 2] for f in self.number]
        self.before = np.searchsorted(axis, [g[0] for g in groups], side="left")
        self.after = np.searchsorted(axis, [g[-1] for g in groups], side="right")
        # A fold listed backwards leaves no period out, and none is taken twice.
        self.after = np.maximum(self.after, self.before)
        self.members = [np.flatnonzero(np.isin(axis, g)) for g in groups]

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of a count over the training and over the test periods."""
        upto = np.r_[0, np.cumsum(values)]
        return upto[self.before] + upto[-1] - upto[self.after], np.array([values[m].sum() for m in self.members])

    def sides(self, state) -> tuple:
        """States of the training and of the test periods of each fold."""
        test = []
        for m in self.members:
            own = tuple(np.zeros_like(s[0]) for s in state)
            for t in m:
                own = merge(own, tuple(s[t] for s in state))
            test.append(own)
        return outside(state, 0, self.before, self.after), tuple(np.stack(s) for s in zip(*test))


def _within_cross(cells: DataFrame, axis: np.ndarray, folds: Folds, entity: str, k: int) -> np.ndarray:
    """Within cross sums of each fold's training rows, and last of all rows: entities' own
    cross sums, added up. Each task adds those of its entities."""
    names, before, after = _names(k), np.r_[folds.before, 0], np.r_[folds.after, 0]
    size = (k + 1) ** 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(before), k + 1, k + 1))
        step = max(1, ENTITY_CELLS // ((len(axis) + 1) * size))
        for batch in batches:
            lists = batch.column("cells")
            values = lists.flatten()
            rows = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in ["period", *names]]).astype(float)
            edges = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for lo in range(0, len(edges) - 1, step):
                hi = min(lo + step, len(edges) - 1)
                part = rows[edges[lo]:edges[hi]]
                dense = np.zeros((hi - lo, len(axis), len(names)))
                owner = np.repeat(np.arange(hi - lo), np.diff(edges[lo:hi + 1]))
                dense[owner, np.searchsorted(axis, part[:, 0])] = part[:, 1:]
                total += outside(_state(dense, k), 1, before, after)[2].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))], ["cell", "value"]
        )

    listed = cells.groupBy(entity).agg(F.collect_list(F.struct("period", *names)).alias("cells")).select("cells")
    sums = listed.mapInArrow(task, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(len(before) * size)
    for row in sums.collect():
        out[row["cell"]] = row["value"]
    return out.reshape(len(before), k + 1, k + 1)


def _slopes(cross: np.ndarray) -> np.ndarray | None:
    try:
        return solve(cross[1:, 1:], cross[1:, 0])
    except ValueError:
        return None


def cv_rmse(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    entity: str,
    period: str,
    folds: DataFrame | None = None,
    model: str = "within",
    min_rows: int = 50,
    width: int = 5,
) -> DataFrame:
    """One row per fold: row counts, status, slopes and slope-only RMSE on both sides.

    ``model`` is "within" (entity effects) or "between_period". A fold with an empty side,
    with fewer than ``min_rows`` rows on a side or without a fit has NULL errors. Rows without a
    period take no part.
    """
    xs, k = list(xs), len(xs)
    marked = model_frame_marked(df, y, xs, period, [entity] if model == "within" else []).filter("period IS NOT NULL")
    by_period = marked.groupBy("period").agg(F.count("*").alias("rows"), *moment_columns(k))

    def cells() -> DataFrame:
        complete = marked.filter("v0 IS NOT NULL").filter(F.col(entity).isNotNull())
        return complete.groupBy(entity, "period").agg(*moment_columns(k))

    def errors(slopes: np.ndarray) -> DataFrame:
        residual = F.col("v0") - sum((float(b) * F.col(f"v{i}") for i, b in enumerate(slopes, 1)), F.lit(0.0))
        return marked.withColumn("v0", residual).groupBy("period").agg(*moment_columns(k))

    return fold_errors(by_period, cells, errors, xs, entity, folds, model, min_rows, width)


def fold_errors(
    by_period: DataFrame,
    cells: Callable[[], DataFrame],
    errors: Callable[[np.ndarray], DataFrame],
    xs: Sequence[str],
    entity: str,
    folds: DataFrame | None,
    model: str,
    min_rows: int,
    width: int,
) -> DataFrame:
    """``cv_rmse`` from moments: those per period with their ``rows``, those per (entity, period),
    and those per period of the residuals under given slopes in place of the response."""
    if model not in ("within", "between_period"):
        raise ValueError(f"unknown model {model!r}")
    xs, k = list(xs), len(xs)
    names = _names(k)
    spark = by_period.sparkSession
    by_period = measured(by_period)[0]
    folds = measured(folds if folds is not None else make_folds(by_period, "period", width))[0]
    table = _table(by_period, ["period", "rows", *names])
    table = table[np.argsort(table[:, 0])]
    axis = table[:, 0]
    schema = T.StructType(
        [T.StructField("fold", T.IntegerType()), T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
         T.StructField("status", T.StringType())]
        + [T.StructField(f"b_{x}", T.DoubleType()) for x in xs]
        + [T.StructField("rmse_train", T.DoubleType()), T.StructField("rmse_test", T.DoubleType())]
    )
    if folds.isEmpty():
        return spark.createDataFrame([], schema)
    place = Folds(axis, folds)
    n_train, n_test = place.sums(table[:, 1])

    if model == "within":
        cross = _within_cross(cells(), axis, place, entity, k)
    else:
        # Each period counts once, with its means.
        n, mean, _ = _state(table[:, 2:], k)
        single = ((n > 0).astype(float), mean, np.zeros((len(axis), k + 1, k + 1)))
        train = outside(single, 0, np.r_[place.before, 0], np.r_[place.after, 0])
        cross = train[2]
    slopes = [_slopes(c) for c in cross]
    reference = slopes[-1] if slopes[-1] is not None else np.zeros(k)

    found = _table(errors(reference), ["period", *names])
    found = found[np.argsort(found[:, 0])]
    sides = place.sides(_state(found[:, 1:], k))

    def rmse(side, at: int, b: np.ndarray) -> float | None:
        n, mean, cross = (s[at] for s in side)
        if not n:
            return None
        w = np.r_[1.0, reference - b]
        spread = w @ cross @ w / n
        noise = 1e-12 * float(np.abs(w) @ np.abs(cross) @ np.abs(w)) / n
        if spread < -noise:
            raise ArithmeticError("a sum of squares came out negative")
        return float(np.sqrt(max(spread, 0.0) + float(w @ mean) ** 2))

    out = []
    for at, fold in enumerate(place.number):
        b, counts = slopes[at], (int(n_train[at]), int(n_test[at]))
        status = "empty" if 0 in counts else "too_few_rows" if min(counts) < min_rows else "no_fit" if b is None else "ok"
        e = [rmse(side, at, b) if status == "ok" else None for side in sides]
        out.append((int(fold), *counts, status, *([None] * k if b is None else map(float, b)), *e))
    return spark.createDataFrame(out, schema)


def model_frame_marked(df: DataFrame, y: str, xs: Sequence[str], period: str, carry: Sequence[str] = ()) -> DataFrame:
    """Every row, with NULL in all model variables where one of them is missing."""
    names = [y, *xs]
    values = [clean(F.col(c).cast("double")) for c in names]
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    return df.select(
        *carry,
        F.col(period).cast("int").alias("period"),
        *[F.when(complete, v).alias(f"v{i}") for i, v in enumerate(values)],
    )


def cv_report(errors: DataFrame) -> DataFrame:
    """Mean errors over the usable folds, and which side is smaller."""
    means = errors.agg(
        F.count_if(F.col("status") == "ok").alias("folds_used"),
        F.avg("rmse_train").alias("mean_rmse_train"),
        F.avg("rmse_test").alias("mean_rmse_test"),
    )
    verdict = (
        F.when(F.col("mean_rmse_train") < F.col("mean_rmse_test"), "train_better")
        .when(F.col("mean_rmse_train") > F.col("mean_rmse_test"), "test_better")
        .when(F.col("mean_rmse_train").isNotNull(), "equal")
    )
    return means.withColumn("verdict", verdict)
