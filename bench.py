"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlake.checks import load_queries  # noqa: E402
from wardlake.session import get_spark  # noqa: E402

HEADLINE = [
    "visit_history",
    "past_ed_visits",
    "past_ed_visits_blocks",
    "fill_ethnicity",
    "icu_transfer",
    "comorbidity_flags",
    "lookback_codes",
    "code_list_v10",
    "labs_in_stay",
    "lab_pivot",
    "vitals_on_stays",
    "medication_counts",
    "resampled_series",
    "remove_outliers",
    "exact_medians",
    "score_news",
    "complaint_flags",
    "document_flags",
    "score_metrics",
    "order_value_metrics",
    "bootstrap_intervals",
    "budget_curve",
    "segmented_row_text",
    "master_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = get_spark(
        f"local[{cpus}]",
        "wardlake-bench",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    # One small query starts the executor threads, so that no timed query pays for it.
    queries["age"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
