"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data folder and
BENCH_CPUS (default 8) the number of local threads. Each query runs twice; the
reported seconds are those of the second run, ``cold`` holds the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfsight.queries import all_queries  # noqa: E402
from shelfsight.session import configure  # noqa: E402

HEADLINE = (
    "opportunity_score",
    "market_brief",
    "market_brief_by_category",
    "pareto_curve",
    "pareto_headline",
    "brand_revenue_top10",
    "concentration_by_category",
    "attr_price_box",
    "attr_numeric_top50",
    "price_bins",
    "price_tiers_by_category",
    "line_price_quartiles",
    "size_bands",
    "parent_synthetic",
    "merge_history",
    "merge_orders_lines",
    "correlation_long",
    "title_keywords",
    "document_keywords",
    "params_long",
    "clean_currency",
    "history_clean",
    "market_kpis_by_category",
)


def seconds(spark: SparkSession, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfsight-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = all_queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = seconds(spark, queries[name], sf_dir)
        warm[name] = seconds(spark, queries[name], sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
