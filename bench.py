"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_REPEATS the measured
runs of each query (2). Every query runs once unmeasured, then its best time counts, from building
the plan to the last row; rows go to a sink that discards them, so nothing is collected. ``plan`` is
the part of that time before the last job starts: building the plan, and jobs it needs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from duecall import configure  # noqa: E402
from workload.spark_queries import QUERIES  # noqa: E402

HEADLINE = [
    "clean_output", "clean_replies", "predict_batch", "accuracy_by_language", "mismatch_report",
    "classification_report", "payment_reminders", "assemble_transcripts", "assemble_for_prompt",
    "success_rate", "load_sweep", "latency_quantiles", "latency_histogram", "gpu_gauges",
    "synth_gold_counts", "stream_dispositions", "stream_request_metrics",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duecall-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        # small inputs: let every core have a split
        .config("spark.sql.files.openCostInBytes", str(1 << 18))
        # call sites in error messages cost more than the plans of these queries
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return configure(spark)


def run(spark: SparkSession, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds of the whole run, and of building its plan."""
    start = time.perf_counter()
    frame = QUERIES[name](spark, sf_dir)
    planned = time.perf_counter() - start
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times, plans = {}, {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        best = min(run(spark, name, sf_dir) for _ in range(repeats))
        times[name], plans[name] = (round(seconds, 3) for seconds in best)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "plan": plans,
                "sf": float(scale.group(1)) if scale else None,
                "cleaned_rows_per_sec": round(documents / times["clean_output"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
