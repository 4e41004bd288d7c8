"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelyard.operators.sizing import release
from panelyard.plans.catalog import QUERIES
from panelyard.session import build_session

HEADLINE = [
    "ratio_index", "scenario_baseline", "melt_year_columns", "entity_baseline", "income_baseline",
    "groups_with_data", "lag5", "five_number", "histogram", "ols", "within", "between",
    "random_effects", "robust_errors", "residuals", "hausman_test", "bp_studentized", "bp_by_entity",
    "bh_adjusted", "scenario_projection", "band", "region_summary_rows", "pct_change", "factor_report",
    "cv_within", "cv_between_time", "fitted_bands",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench")
    QUERIES["scenario_baseline"](spark, sf_dir).collect()   # start-up: class loading, codegen, file listing
    spark.catalog.clearCache()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release()
        spark.catalog.clearCache()   # no query may live off another one's cached tables
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
