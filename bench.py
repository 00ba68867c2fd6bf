"""Run the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from callsheet.plans.registry import registry

HEADLINE = (
    "scan_email",
    "scan_rollup",
    "scan_cap",
    "severity_counts",
    "report_lines",
    "envelope",
    "body_policy",
    "header_select",
    "json_counts",
    "artifact_parts",
    "secret_list",
    "redact_counts",
    "fake_vin",
    "pseudonym_map",
    "pseudonymized_entries",
    "render_prompt",
    "run_responses",
    "retry_backfill",
    "run_matrix",
    "response_outline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("callsheet-bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry()
    chosen = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        plans[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps(line | {"sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
