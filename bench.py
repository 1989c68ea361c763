"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from resight.catalog import QUERIES  # noqa: E402
from resight.session import job, local_session  # noqa: E402

HEADLINE = [
    "read_csv_dir", "standardize", "survey_weeks", "attach_periods", "classify_sex", "sex_ratios", "impute_category", "final_select",
    "histories", "at_risk", "js_from_histories", "observed_rates", "collapse_groups", "count_tensor", "transition_table",
    "js_quantities", "lambda_varying", "movement_forward", "rate_to_transition", "abundance_path", "residence_abundance",
    "score_js", "score_histories", "history_probability", "expected_by_history", "deconvolve_entries", "fit_grid", "abundance_by_year",
    "summarize_draws", "exact_quantiles", "draw_mode", "compare_methods", "draw_histogram", "row_index",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{d}/events.parquet").count()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        with job(spark, name):
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
