"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores), BENCH_RUNS (default 3)
and BENCH_QUERIES (comma-separated names) choose what is run. Each query runs once to warm up,
then BENCH_RUNS times; its time is the median, with all rows materialised by Spark.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import catalog, fixtures  # noqa: E402

HEADLINE = [
    "quality_report",
    "typed_rows",
    "ad_metrics",
    "ad_financials",
    "campaign_names",
    "overview_totals",
    "funnel_conversion",
    "campaign_rollup",
    "audience_all_sets",
    "audience_by_interest",
    "audience_campaign_age",
    "high_spend_low_conversion",
    "sensitivity",
    "insight_overview",
    "insight_audiences",
    "filter_options",
    "feature_table",
    "scaled_features",
    "split_sizes",
    "confusion_metrics",
    "roc_auc",
    "roc_curve",
    "pr_curve",
    "threshold_sweep",
    "strategy_comparison",
    "segment_medians",
    "recommendations",
    "recommendation_reason",
    "executive_summary",
    "findings",
    "report_campaign_summary",
    "report_recommendations",
]


#: Queries timed with the medians and fits they share worked out anew.
FRESH = {"recommendations", "scaled_features", "split_sizes"}


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or "*"
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("adfathom-bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def materialise(name: str) -> None:
        if name in FRESH:
            catalog.forget()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    times = {"store_campaign_table": timed(lambda: fixtures.ads(spark, folder).count())}
    for name in names:
        materialise(name)
        times[name] = statistics.median(timed(lambda: materialise(name)) for _ in range(runs))
    if not wanted:
        times["train_two_models"] = timed(lambda: materialise("leaderboard"))
        times["predictions"] = timed(lambda: materialise("predictions"))
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in times.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "ads": fixtures.ads(spark, folder).count(),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
