"""Time the headline queries; one JSON line on stdout.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and runs on ``local[$BENCH_CPUS]``.
``python bench.py name ...`` times only those queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lakewarden.plans import load
from lakewarden.session import build_session

HEADLINES = (
    "scan_text",
    "redact_text",
    "scan_summary",
    "match_policies",
    "resolve_urn",
    "decide_requests",
    "seal_chain",
    "verify_chain",
    "request_fingerprint",
    "capped_results",
    "decisions_by_policy",
    "holdback_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # One small query first, so that the JVM's start is not charged to the first headline.
    queries["label_ancestors"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(sf_dir.rsplit("sf", 1)[-1]) if "sf" in sf_dir else None,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
