"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8). Each query is
built and fully evaluated; its time includes every job it starts. ``stage_*`` are the frames that
Spark derives once and stores: the bookings table, its cleaned form and its imputed form. Times go to the error
output as they are taken.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import queries as q
from lodgewise.session import local_session

STAGES = {"stage_bookings": q.raw, "stage_engineered": q.engineered, "stage_imputed": q.imputed}
HEADLINE = [
    "scan_noshow",
    "dashboard_kpis",
    "engineer_features",
    "rate_by_platform",
    "rate_by_column",
    "column_summary",
    "impute_room",
    "impute_price",
    "imputation_shift",
    "stratified_split",
    "kfold_assign",
    "sample_n",
    "standard_scale",
    "numeric_histogram",
    "rate_by_quantile",
    "iqr_outliers",
    "duplicate_count",
    "pearson_matrix",
    "chi_square",
    "cramers_v_matrix",
    "classification_metrics",
    "roc_auc",
    "average_precision",
    "drift_ks",
    "drift_wasserstein",
    "drift_js",
    "preprocess_splits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()  # start the engine
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    for name, stage in STAGES.items():
        timed(name, lambda: stage(spark, folder))
    for name in HEADLINE:
        timed(name, lambda: q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
