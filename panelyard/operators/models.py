"""Panel regressions from distributed moments.

A fit runs one grouped pass over the rows; what reaches the driver is a handful of
k x k sums. Per-entity moments stay in Spark and feed random effects, robust errors
and fixed effects without another pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.linear import inverse, pairs, solve
from panelyard.functions.numeric import normal_quantile
from panelyard.functions.tails import chi2_tail, f_tail, normal_tail, t_tail
from panelyard.operators.moments import (
    group_moments, model_frame, moment_columns, read_cross, read_means, sum_cross,
)
from panelyard.operators.sizing import attach_stats, measured

INTERCEPT = "(Intercept)"
COEF_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"


@dataclass
class Fit:
    """A fitted regression. ``coef`` and ``cov`` start with the intercept if there is one."""

    kind: str
    y: str
    xs: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n_obs: int
    df_resid: int
    ssr: float
    tss: float
    entity: str | None = None
    n_entities: int | None = None
    moments: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    source: DataFrame | None = None

    @property
    def has_intercept(self) -> bool:
        return len(self.coef) > len(self.xs)

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.xs] if self.has_intercept else list(self.xs)

    @property
    def slopes(self) -> np.ndarray:
        return self.coef[1:] if self.has_intercept else self.coef

    @property
    def slope_cov(self) -> np.ndarray:
        return self.cov[1:, 1:] if self.has_intercept else self.cov

    def coefficients(self) -> dict[str, float]:
        return {t: float(b) for t, b in zip(self.terms, self.coef)}

    def _table(self, se: np.ndarray, normal: bool) -> DataFrame:
        stat = self.coef / se
        p = normal_tail(stat) if normal else t_tail(stat, self.df_resid)
        rows = [
            (t, float(b), float(s), float(z), float(q))
            for t, b, s, z, q in zip(self.terms, self.coef, se, stat, p)
        ]
        return self.source.sparkSession.createDataFrame(rows, COEF_SCHEMA)

    def summary(self) -> DataFrame:
        """Coefficient table; normal tails for random effects, t tails otherwise."""
        return self._table(np.sqrt(np.diag(self.cov)), self.kind == "random")

    def tidy(self, conf: float = 0.95) -> DataFrame:
        """Coefficient table with normal confidence limits."""
        q = normal_quantile(0.5 + conf / 2)
        half = q * F.col("std_error")
        return self.summary().withColumns(
            {"conf_low": F.col("estimate") - half, "conf_high": F.col("estimate") + half}
        )

    def statistics(self) -> DataFrame:
        """Goodness of fit as one row: an F statistic, or for random effects (whose coefficients
        have normal tails) a Wald chi-square of the slopes."""
        k = len(self.xs)
        r2 = 1 - self.ssr / self.tss
        adj = 1 - (self.ssr / self.df_resid) / (self.tss / (self.n_obs - 1))
        f = (r2 / k) / ((1 - r2) / self.df_resid)
        kind, p = "f", f_tail(f, k, self.df_resid)
        if self.kind == "random":
            kind, f = "chi2", float(self.slopes @ solve(self.slope_cov, self.slopes))
            p = chi2_tail(f, k)
        row = (
            self.kind, int(self.n_obs), None if self.n_entities is None else int(self.n_entities),
            int(self.df_resid), float(self.ssr), float(self.tss), float(r2), float(adj), float(f), float(p),
        )
        return self.source.sparkSession.createDataFrame(
            [row],
            "model string, n_obs long, n_entities long, df_resid long, ssr double, tss double, "
            f"r_squared double, adj_r_squared double, {kind}_statistic double, {kind}_p_value double",
        )

    def robust_table(self) -> DataFrame:
        """Coefficients with entity-clustered HC0 errors. An entity's score is
        s_i - S_i b, so the middle matrix comes from its moments alone."""
        if self.kind != "within":
            raise ValueError("robust_table needs a within fit")
        k = len(self.xs)
        score = [
            F.col(f"c0_{j}")
            - sum((float(self.coef[a - 1]) * F.col(f"c{min(a, j)}_{max(a, j)}") for a in range(1, k + 1)), F.lit(0.0))
            for j in range(1, k + 1)
        ]
        row = self.moments.agg(
            *[F.sum(score[i - 1] * score[j - 1]).alias(f"g{i}_{j}") for i, j in pairs(k) if i > 0]
        ).first()
        middle = np.empty((k, k))
        for i, j in pairs(k):
            if i > 0:
                middle[i - 1, j - 1] = middle[j - 1, i - 1] = row[f"g{i}_{j}"]
        bread = self.extra["bread"]
        return self._table(np.sqrt(np.diag(bread @ middle @ bread)), normal=False)

    def classic_se(self, n_entities: int | None = None) -> DataFrame:
        """Errors from RSS / (entities - 2) * inverse(X'X); ``n_entities`` defaults to the fitted ones."""
        units = self.n_obs if n_entities is None else n_entities
        cov = self.extra["bread"] * self.ssr / (units - 2)
        rows = [(t, float(b), float(s)) for t, b, s in zip(self.terms, self.coef, np.sqrt(np.diag(cov)))]
        return self.source.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double")

    def _effect(self) -> Column:
        return F.col("m0") - sum((float(b) * F.col(f"m{i}") for i, b in enumerate(self.slopes, 1)), F.lit(0.0))

    def fixed_effects(self) -> DataFrame:
        """Each entity's intercept: mean response minus slopes times mean terms."""
        if self.kind != "within":
            raise ValueError("fixed effects need a within fit")
        return self.moments.select(self.entity, self._effect().alias("fixed_effect"))

    def residuals(self, carry: Sequence[str] = ()) -> DataFrame:
        """Residual per used row (within, pooled) or per group (between)."""
        k = len(self.xs)
        if self.kind == "between":
            fitted = sum((float(b) * F.col(f"m{i}") for i, b in enumerate(self.slopes, 1)), F.lit(float(self.coef[0])))
            return self.moments.select(self.entity, fitted.alias("fitted"), (F.col("m0") - fitted).alias("residual"))
        keys = [self.entity] if self.entity else []
        frame = model_frame(self.source, self.y, self.xs, [*keys, *[c for c in carry if c not in keys]])
        part = sum((float(b) * F.col(f"v{i}") for i, b in enumerate(self.slopes, 1)), F.lit(0.0))
        if self.kind == "within":
            effects = self.moments.select(self.entity, F.col("n").alias("_n"), self._effect().alias("_effect"))
            frame = attach_stats(frame.filter(F.col(self.entity).isNotNull()), effects, keys, weight="_n")
            fitted = part + F.col("_effect")
        elif self.kind == "ols":
            fitted = part + float(self.coef[0])
        else:
            raise ValueError("residuals of a random-effects fit are not defined here")
        return frame.select(
            *[c for c in frame.columns if c not in {f"v{i}" for i in range(k + 1)} | {"_n", "_effect"}],
            fitted.alias("fitted"),
            (F.col("v0") - fitted).alias("residual"),
        )

    def release(self) -> None:
        if self.moments is not None:
            self.moments.unpersist()


def _intercept_system(cross: np.ndarray, means: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """(coef, inverse(Z'Z)) with an intercept, from centred cross sums and means."""
    inner = inverse(cross[1:, 1:])
    slopes = solve(cross[1:, 1:], cross[1:, 0])
    mx = means[1:]
    coef = np.concatenate([[means[0] - mx @ slopes], slopes])
    bread = np.empty((len(coef), len(coef)))
    bread[1:, 1:] = inner
    bread[0, 1:] = bread[1:, 0] = -inner @ mx
    bread[0, 0] = 1.0 / n + mx @ inner @ mx
    return coef, bread


def _linear_fit(kind: str, row, y: str, xs: list[str], **rest) -> Fit:
    k = len(xs)
    cross, means, n = read_cross(row, k), read_means(row, k), row["n"]
    coef, bread = _intercept_system(cross, means, n)
    ssr = float(cross[0, 0] - coef[1:] @ cross[1:, 0])
    df_resid = n - k - 1
    return Fit(
        kind, y, xs, coef, bread * ssr / df_resid, n, df_resid, ssr, float(cross[0, 0]),
        extra={"bread": bread}, **rest,
    )


def fit_ols(df: DataFrame, y: str, xs: Sequence[str], row=None) -> Fit:
    """Pooled least squares with an intercept; ``row`` holds the moments of all rows, if known."""
    row = row if row is not None else model_frame(df, y, xs).agg(*moment_columns(len(xs))).first()
    return _linear_fit("ols", row, y, list(xs), source=df)


def entity_moments(df: DataFrame, y: str, xs: Sequence[str], entity: str) -> DataFrame:
    """Per-entity moments of the complete rows; rows without an entity are left out."""
    frame = model_frame(df, y, xs, [entity]).filter(F.col(entity).isNotNull())
    return measured(group_moments(frame, [entity], len(xs)))[0]


def fit_within(
    df: DataFrame, y: str, xs: Sequence[str], entity: str, moments: DataFrame | None = None
) -> Fit:
    """Fixed effects of ``entity``. Pass the period column to get time effects."""
    xs, k = list(xs), len(xs)
    moments = moments if moments is not None else entity_moments(df, y, xs, entity)
    row = moments.agg(F.sum("n").alias("n"), F.count("*").alias("units"), *sum_cross(k)).first()
    cross = read_cross(row, k)
    coef = solve(cross[1:, 1:], cross[1:, 0])
    bread = inverse(cross[1:, 1:])
    ssr = float(cross[0, 0] - coef @ cross[1:, 0])
    df_resid = row["n"] - row["units"] - k
    return Fit(
        "within", y, xs, coef, bread * ssr / df_resid, row["n"], df_resid, ssr, float(cross[0, 0]),
        entity=entity, n_entities=row["units"], moments=moments, extra={"bread": bread}, source=df,
    )


def fit_between(
    df: DataFrame, y: str, xs: Sequence[str], entity: str, moments: DataFrame | None = None
) -> Fit:
    """Least squares on the unweighted group means. Pass the period column for the time version."""
    xs, k = list(xs), len(xs)
    moments = moments if moments is not None else entity_moments(df, y, xs, entity)
    row = moments.agg(*moment_columns(k, "m")).first()
    return _linear_fit("between", row, y, xs, entity=entity, n_entities=row["n"], moments=moments, source=df)


def fit_random(
    df: DataFrame, y: str, xs: Sequence[str], entity: str, moments: DataFrame | None = None
) -> Fit:
    """Random effects with Swamy-Arora variance components (Baltagi and Chang 1994 when unbalanced)."""
    xs, k = list(xs), len(xs)
    within = fit_within(df, y, xs, entity, moments)
    moments = within.moments
    sigma_e = within.ssr / within.df_resid
    n_rows, units = within.n_obs, within.n_entities

    # Means are shifted by the pooled mean; slopes do not change and squares stay small.
    centre = read_means(
        moments.agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(k + 1)]).first(), k
    )
    d = [F.lit(1.0), *[F.col(f"m{i}") - float(centre[i]) for i in range(1, k + 1)], F.col("m0") - float(centre[0])]
    size = k + 2   # intercept, terms, response

    def weighted(weight: Column, tag: str) -> list[Column]:
        return [F.sum(weight * d[i] * d[j]).alias(f"{tag}{i}_{j}") for i in range(size) for j in range(i, size)]

    def read(row, tag: str) -> np.ndarray:
        out = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                out[i, j] = out[j, i] = row[f"{tag}{i}_{j}"]
        return out

    t = F.col("n").cast("double")
    row = moments.agg(*weighted(t, "p"), *weighted(t * t, "q")).first()
    p, q = read(row, "p"), read(row, "q")
    z = slice(0, k + 1)
    b_between = solve(p[z, z], p[z, -1])
    q_between = float(p[-1, -1] - b_between @ p[z, -1])
    trace = float(np.trace(solve(p[z, z], q[z, z])))
    sigma_u = max(0.0, (q_between - (units - k - 1) * sigma_e) / (n_rows - trace))

    shrink = sigma_e / (sigma_e + t * sigma_u)   # (1 - theta_i)^2
    cross_row = moments.agg(*weighted(t * shrink, "g"), *sum_cross(k)).first()
    gram = read(cross_row, "g")
    inner = read_cross(cross_row, k)
    order = [*range(1, k + 1), 0]
    gram[1:, 1:] += inner[np.ix_(order, order)]
    coef = solve(gram[z, z], gram[z, -1])
    ssr = float(gram[-1, -1] - coef @ gram[z, -1])
    df_resid = n_rows - k - 1
    bread = inverse(gram[z, z])
    # Back to unshifted terms: the intercept takes up the shift.
    back = np.eye(k + 1)
    back[0, 1:] = -centre[1:]
    coef = back @ coef
    coef[0] += centre[0]
    bread = back @ bread @ back.T
    tss = float(gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0])
    return Fit(
        "random", y, xs, coef, bread * ssr / df_resid, n_rows, df_resid, ssr, tss,
        entity=entity, n_entities=units, moments=moments,
        extra={"bread": bread, "sigma_e": sigma_e, "sigma_u": sigma_u}, source=df,
    )


def variance_components(fit: Fit) -> DataFrame:
    """Idiosyncratic and entity variance of a random-effects fit as one row."""
    return fit.source.sparkSession.createDataFrame(
        [(float(fit.extra["sigma_e"]), float(fit.extra["sigma_u"]))], "sigma2_e double, sigma2_u double"
    )


def normal_interval(estimate: float, std_error: float, conf: float = 0.95) -> tuple[float, float]:
    """Normal confidence limits of one typed-in estimate."""
    half = normal_quantile(0.5 + conf / 2) * std_error
    return estimate - half, estimate + half


def coef_sets(fit: Fit, conf: float = 0.95) -> dict[str, dict[str, float]]:
    """Slopes as fit / low / high sets for the projection."""
    sets: dict[str, dict[str, float]] = {"fit": {}, "low": {}, "high": {}}
    for name, b, v in zip(fit.xs, fit.slopes, np.diag(fit.slope_cov)):
        low, high = normal_interval(float(b), float(np.sqrt(v)), conf)
        sets["fit"][name], sets["low"][name], sets["high"][name] = float(b), low, high
    return sets
