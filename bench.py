"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The given Parquet files hold a single row group, which one task must read alone.  The
bench first rewrites the tables it needs as one file per core, as a cluster would hold
them, and counts that time in the total.  Results go to Spark's noop sink, so every
column of every row is computed; the cleaning jobs write real Parquet.

`cleaning_job_from_csv` is the whole cleaning job (audit, write, report) over CSV files with all 80 columns, which
are written before and not timed, since a capture arrives as such files.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import catalog
from flowintel.operators.clean import clean_flows
from flowintel.plans import jobs
from flowintel.session import build_session
from flowintel.sources import tables
from flowintel.sources.flowview import lineitem_flows

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INPUTS = ["lineitem", "orders", "events", "documents"]
HEADLINE = [
    "clean_metrics_by_file", "profile_tokens", "clean_flows", "class_distribution", "temporal_profile", "traffic_stats",
    "port_concentration", "feature_correlations", "flow_aggregates", "threat_profiles", "split_global",
    "split_per_class", "class_weights", "sampling_summary", "model_diagnostics", "threshold_sweep", "policy_comparison",
    "manifest_digest", "table_hash", "model_evaluation",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__sql__shuffle__partitions=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    work = tempfile.mkdtemp(prefix="flowintel-bench-")

    def spread() -> None:
        for name in INPUTS:
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{work}/{name}.parquet")

    def job_from_csv() -> None:
        for section in jobs.run_cleaning(spark, f"{work}/csv", f"{work}/from_csv").values():
            section.collect()

    seconds = {"prepare_inputs": timed(spread)}
    csv_seconds = None
    if not sys.argv[1:]:
        csv_seconds = timed(lambda: lineitem_flows(spark, work).drop("source_file").write.option("header", True).csv(f"{work}/csv"))
        seconds["cleaning_job_from_csv"] = timed(job_from_csv)
    for name in names:
        if name == "class_distribution":
            seconds["cleaning_job_to_parquet"] = timed(
                lambda: tables.write_curated(clean_flows(lineitem_flows(spark, work)), f"{work}/curated", rebalance=True))
        seconds[name] = timed(lambda: catalog.QUERIES[name](spark, work).write.format("noop").mode("overwrite").save())
    rows = spark.read.parquet(f"{work}/lineitem.parquet").count()
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "raw_rows": rows, "csv_written_sec": csv_seconds,
        "rows_per_sec": {n: round(rows / s) for n, s in seconds.items() if s > 0},
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
