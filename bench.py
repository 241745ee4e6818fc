"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Every
query runs to the end (a full write to a sink that keeps nothing), so building,
planning, staged steps and execution all count.  ``stage_inputs`` is the time to
build the stored inputs that single-operator queries start from; the flagship
``gate_decision`` never uses them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from changegate.plans import catalogue
from changegate.plans.diffing import gate_changes
from changegate.plans.tracing import gate_context, reached_columns
from changegate.session import clean_up, local_session

HEADLINE = (
    "gate_decision",
    "schema_diff",
    "infer_renames",
    "downstream_reach_parts",
    "enrich_assets",
    "link_assertions",
    "assess",
    "merge_context",
    "fact_conflicts",
    "audit_pages",
    "daily_revenue",
    "reconcile",
    "test_report",
    "gate_run_results",
    "interface_proof",
    "scan_verdict",
    "verify_checksums",
    "readback_match",
    "content_digest",
    "manifest_columns",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    partitions = int(cpus) if cpus.isdigit() else 8
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="changegate-bench-")
    spark = local_session(cpus, shuffle_partitions=partitions, app="changegate-bench", shared=shared)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers

    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    def run(name: str) -> None:
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    if "gate_decision" in names:
        timed("gate_decision", lambda: run("gate_decision"))

    def stage() -> None:
        gate_changes(spark, sf_dir)
        reached_columns(spark, sf_dir)
        gate_context(spark, sf_dir)

    timed("stage_inputs", stage)
    for name in names:
        if name != "gate_decision":
            timed(name, lambda name=name: run(name))
    line = {
        "metric": "headline_queries_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    clean_up(spark)
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
