"""Headline queries, one warm-up and the median of three runs each; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Results go to the ``noop``
sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from relaylens.plans import catalogue  # noqa: E402
from relaylens.session import build_session  # noqa: E402

HEADLINE = ["metrics_by_module", "recent_errors", "route_switchboard", "route_asof_cooldown",
            "pii_mask", "pii_restore", "inj_scan", "inj_verdict", "quality_score",
            "breaker_replay", "upsert_overwrite"]


def timed(run, spark, sf_dir) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    for name in names:
        timed(queries[name], spark, sf_dir)
        seconds[name] = round(statistics.median(
            timed(queries[name], spark, sf_dir) for _ in range(3)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
