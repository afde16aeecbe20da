"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.plans.queries import QUERIES
from logtriage.plans.request_logs import request_logs

HEADLINE = [
    "detect_by_family",
    "detect",
    "canonicalize",
    "signals",
    "canonicalize_texts",
    "html_pages",
    "scan_lines",
    "alerts",
    "extract_observation",
    "import_requests",
    "first_distinct",
    "records",
    "corpus_stats",
    "evaluate",
    "roc_auc",
    "calibrate",
    "error_counts",
    "family_rates",
    "char_vocab",
    "encode_chars",
    "shuffle",
    "stream_detect",
]


def run(df: DataFrame) -> None:
    """Compute every row and column, keep none."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logtriage-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["detect_by_family"](spark, sf_dir))  # start-up and code generation

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)

    lines = request_logs(spark, sf_dir).agg(F.count(F.lit(1))).first()[0]
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else sf_dir,
                "lines": lines,
                "detect_lines_per_second": round(lines / seconds["detect"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
