"""Moments of a panel kept as a table: new periods are added, and fits and folds read no rows again.

A store is a folder of Parquet files with one row of moments per (entity, period) and append. An
append reads the new rows only and leaves the old files alone. A fit merges the cells it needs by
the pairwise update, so a cell that several appends hold (rows that came late) is their union.

Appends have names. Spark shows an append's files when its job is committed, so one that failed
leaves nothing that is read; writing a name twice is an error, so a job that is run again counts no
row twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.linear import pairs
from panelyard.functions.numeric import clean
from panelyard.operators.crossval import fold_errors
from panelyard.operators.models import Fit, fit_between, fit_ols, fit_random, fit_within
from panelyard.operators.moments import merge_moments, merged_row, moment_columns
from panelyard.operators.sizing import measured


class MomentStore:
    """Moments of ``y`` and ``xs`` per (``entity``, ``period``) under ``path``.

    Rows with a missing variable count in ``rows`` only. Rows without an entity or a period are
    kept as cells of their own: fits by a key leave out those without that key.
    """

    def __init__(self, spark: SparkSession, path: str, y: str, xs: Sequence[str], entity: str, period: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.y, self.xs, self.entity, self.period = y, list(xs), entity, period

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MomentStore:
        """A store that holds at least one append; its variables are named in its files."""
        fields = {f.name: f.metadata.get("variable") for f in spark.read.parquet(path).schema.fields}
        if not {"entity", "period", "m0"} <= {n for n, v in fields.items() if v}:
            raise ValueError(f"{path} is no store of moments")
        xs = [fields[f"m{i}"] for i in range(1, sum(n[0] == "m" for n in fields))]
        return cls(spark, path, fields["m0"], xs, fields["entity"], fields["period"])

    @property
    def k(self) -> int:
        return len(self.xs)

    def append(self, df: DataFrame, name: str) -> None:
        """Add the rows of ``df`` under a new name."""
        names = [self.y, *self.xs]
        values = [clean(F.col(c).cast("double")) for c in names]
        complete = F.lit(True)
        for v in values:
            complete = complete & v.isNotNull()
        rows = df.select(
            F.col(self.entity).alias("entity"), F.col(self.period).alias("period"),
            *[F.when(complete, v).alias(f"v{i}") for i, v in enumerate(values)],
        )
        self._write(rows.groupBy("entity", "period").agg(F.count("*").alias("rows"), *moment_columns(self.k)), name)

    def _write(self, cells: DataFrame, name: str) -> None:
        called = {"entity": self.entity, "period": self.period} | {f"m{i}": v for i, v in enumerate([self.y, *self.xs])}
        marked = [F.col(c).alias(c, metadata={"variable": called[c]}) if c in called else F.col(c) for c in cells.columns]
        cells.select(*marked).write.mode("errorifexists").parquet(f"{self.path}/append={name}")

    def cells(self) -> DataFrame:
        """All cells as they were added."""
        return self.spark.read.parquet(self.path).drop("append")

    def moments(self, key: str) -> DataFrame:
        """Moments by entity or by period, with the store's own column name."""
        column = {self.entity: "entity", self.period: "period"}[key]
        parts = self.cells().filter(F.col(column).isNotNull() & (F.col("n") > 0)).withColumnRenamed(column, key)
        return measured(merge_moments(parts, [key], self.k))[0]

    def compact(self, path: str) -> MomentStore:
        """The same store under another path, with one row per (entity, period)."""
        out = MomentStore(self.spark, path, self.y, self.xs, self.entity, self.period)
        out._write(merge_moments(self.cells(), ["entity", "period"], self.k, sums=["rows"]), "all")
        return out

    # Every fit below is the one of ``operators.models``, from the stored moments.

    def ols(self) -> Fit:
        cells = self.cells()
        return fit_ols(cells, self.y, self.xs, row=merged_row(cells, self.k))

    def within(self, key: str | None = None) -> Fit:
        key = key or self.entity
        return fit_within(self.cells(), self.y, self.xs, key, self.moments(key))

    def between(self, key: str | None = None) -> Fit:
        key = key or self.entity
        return fit_between(self.cells(), self.y, self.xs, key, self.moments(key))

    def random(self) -> Fit:
        return fit_random(self.cells(), self.y, self.xs, self.entity, self.moments(self.entity))

    def cv(
        self, folds: DataFrame | None = None, model: str = "within", min_rows: int = 50, width: int = 5
    ) -> DataFrame:
        """``cv_rmse`` of the rows that were added."""
        k = self.k
        parts = self.cells().withColumn("period", F.col("period").cast("int")).filter("period IS NOT NULL")

        def cells() -> DataFrame:
            return merge_moments(parts.filter("entity IS NOT NULL AND n > 0"), ["entity", "period"], k)

        def errors(slopes: np.ndarray) -> DataFrame:
            return merge_moments(residual_moments(parts, slopes), ["period"], k)

        by_period = merge_moments(parts, ["period"], k, sums=["rows"])
        return fold_errors(by_period, cells, errors, self.xs, "entity", folds, model, min_rows, width)


def residual_moments(parts: DataFrame, slopes: np.ndarray) -> DataFrame:
    """Cells with the residual under ``slopes`` in place of the response. It is taken inside each
    cell, ahead of any merge, so that the levels of the terms drop out before they are squared."""
    k = len(slopes)
    weight = [1.0, *[-float(b) for b in slopes]]

    def cross(i: int, j: int):
        return F.col(f"c{min(i, j)}_{max(i, j)}")

    def total(terms):
        return sum(terms, F.lit(0.0))

    out = {"m0": total(F.col(f"m{i}") * w for i, w in enumerate(weight))}
    out |= {f"c0_{j}": total(cross(i, j) * w for i, w in enumerate(weight)) for _, j in pairs(k) if j > 0}
    own = total(cross(i, j) * (w * v) for i, w in enumerate(weight) for j, v in enumerate(weight))
    out["c0_0"] = F.when(own.isNotNull(), F.greatest(own, F.lit(0.0)))
    return parts.withColumns(out)
