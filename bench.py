"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Session start is excluded and one small query warms the JVM.  Each query is timed to its full
result (noop sink), best of BENCH_RUNS.  ``events_per_sec`` is issue_rollup, i.e. fingerprint,
dedupe and rollup of all deliveries including their derivation from the events table.
BENCH_MIXED=n adds the same over n generated events.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from issueforge.operators import issues  # noqa: E402
from issueforge.registry import QUERIES  # noqa: E402
from issueforge.session import build_session, materialize  # noqa: E402
from issueforge.sources import generators  # noqa: E402

HEADLINE = (
    "fingerprint", "dedupe_events", "issue_rollup", "issue_ids", "events_with_issue", "issues_sorted",
    "issue_recent_events", "rolling_issue_count", "alert_feed", "delivery_results", "validation_report",
    "normalize_message", "normalize_module", "eval_report", "pair_confusion", "metric_summary", "parse_stack",
    "breadcrumbs_asof", "stream_dedupe",
)


def timed(make) -> float:
    started = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", cpus, 8, **{"spark.ui.showConsoleProgress": "false"})
    timed(lambda: QUERIES["issue_rollup"](spark, "/root/testdata/sf0.001"))
    took = {}
    for name in HEADLINE:
        took[name] = round(min(timed(lambda: QUERIES[name](spark, sf_dir)) for _ in range(runs)), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    deliveries = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "deliveries": deliveries,
        "events_per_sec": round(deliveries / took["issue_rollup"], 1),
    }
    mixed = int(os.environ.get("BENCH_MIXED", "0"))
    if mixed:
        stream = generators.mixed_stream(spark.range(mixed).select(F.col("id").alias("seq")))
        stored = materialize(stream.repartition(2 * int(cpus)), "mixed")
        spent = timed(lambda: issues.rollup_partials(issues.dedupe(issues.fingerprinted(stored))))
        result["mixed_stream"] = {"events": mixed, "sec": round(spent, 3), "events_per_sec": round(mixed / spent, 1)}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
