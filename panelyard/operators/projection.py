"""Re-anchored intercepts, scenario projection and scenario summaries.

``terms`` maps a term name to its expression over the table at hand; ``coefs`` maps a
set name (fit, low, high) to {term: coefficient}. The terms are given for anchoring and
for projecting separately, so other terms than the fitted ones can be used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import clean
from panelyard.operators.baseline import with_group_stats

CoefSets = Mapping[str, Mapping[str, float]]


def linear_part(terms: Mapping[str, Column], coefs: Mapping[str, float]) -> Column:
    missing = set(coefs) - set(terms)
    if missing:
        raise ValueError(f"no expression for terms {sorted(missing)}")
    return sum((float(b) * terms[t] for t, b in coefs.items()), F.lit(0.0))


def coef_table(spark, coefs: CoefSets) -> DataFrame:
    """The coefficient sets as rows (set, term, value)."""
    return spark.createDataFrame(
        [(s, t, float(v)) for s, values in coefs.items() for t, v in values.items()],
        "set string, term string, value double",
    )


def anchor_intercepts(
    df: DataFrame,
    entity: str,
    period: str,
    y: str,
    terms: Mapping[str, Column],
    coefs: CoefSets,
    at: int,
    prefix: str = "intercept",
) -> DataFrame:
    """Per entity the intercept that puts the model through the observed value at ``at``."""
    return df.filter(F.col(period) == at).select(
        entity, *[(F.col(y) - linear_part(terms, c)).alias(f"{prefix}_{s}") for s, c in coefs.items()]
    )


def project(
    scenarios: DataFrame,
    intercepts: DataFrame | None,
    entity: str,
    terms: Mapping[str, Column],
    coefs: CoefSets,
    out: str = "proj",
    prefix: str = "intercept",
    level: bool = False,
) -> DataFrame:
    """Scenario rows with ``out``_<set> = intercept + coefficients times terms. Entities
    without an intercept keep their rows, with NULL projections. ``intercepts=None`` leaves
    the intercept out; ``level=True`` gives exp of the projection."""
    rows = scenarios if intercepts is None else scenarios.join(intercepts, entity, "left")
    new = {}
    for name, c in coefs.items():
        value = linear_part(terms, c)
        if intercepts is not None:
            value = F.col(f"{prefix}_{name}") + value
        new[f"{out}_{name}"] = F.exp(value) if level else value
    return rows.withColumns(new)


def scenario_summary(
    proj: DataFrame,
    group: str,
    scenario: str = "scenario",
    period: str = "year",
    values: Mapping[str, str] | None = None,
    out: str = "index",
    levels: bool = True,
    collapse: bool = False,
) -> DataFrame:
    """Group means of fit / upper / lower per (group, scenario, period), on the log scale
    and, with ``levels``, as means of exp. Rows without a group are dropped.

    ``collapse=True`` gives one row per group: a single combined aggregate and all a chart
    needs. Otherwise every projection row is kept.
    """
    values = values or {"fit": "proj_fit", "upr": "proj_high", "lwr": "proj_low"}
    stats = {f"{out}_{k}": F.avg(clean(c)) for k, c in values.items()}
    if levels:
        stats |= {f"exp_{out}_{k}": F.avg(F.exp(clean(c))) for k, c in values.items()}
    known = proj.filter(F.col(group).isNotNull())
    keys = [group, scenario, period]
    if collapse:
        return known.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return with_group_stats(known, keys, stats)
