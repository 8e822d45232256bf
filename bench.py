"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores of the local session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "flagship_momentum_top10",
    "feature_matrix",
    "wn13_indicator_block",
    "wn24_cross_section_rank",
    "wn25_percentile_score",
    "jn01_external_series",
    "ag05_consolidate_oof",
    "ag08_classification_metrics",
    "va13_tuned_weights",
    "pt08_portfolio_summary",
    "pt02_turnover_limit",
    "st04_greedy_news_dedupe",
    "jn08_company_mapping",
    "ag15_rule_summary",
    "ag18_bucket_summaries",
    "tk10_recommendations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from tickloom.plans import load_all
    from tickloom.plans.registry import QUERIES
    from tickloom.session import local_session

    spark = local_session(cpus, app="tickloom-bench", memory="16g")
    load_all()
    names = sys.argv[1:] or HEADLINE
    bars = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of the runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "input_rows_per_sec": {name: round(bars / sec) for name, sec in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
