"""Windows of all sizes from panes, against plain counting."""

import random
from datetime import datetime, timedelta

from relaylens.session import scratch_path
from relaylens.sources import schemas
from relaylens.sources.state_table import StateTable
from relaylens.streaming import rollups, sinks

START = datetime(2024, 3, 1, 5, 0, 0)
SIZES = ((3, 1), (12, 4))


def rows(rng, base, n, minute):
    return [(base * 1000 + i, START + timedelta(seconds=60 * minute + rng.randint(0, 1500)), "m",
             rng.choice(["a", "a", None]), "t", None if rng.random() < 0.3 else float(i),
             rng.random() < 0.6, None) for i in range(n)]


def counted(seen, until):
    out = {}
    for _, ts, _, module, _, ms, ok, _ in seen:
        for width, slide in SIZES:
            minute = int((ts - START).total_seconds() // 60)
            for start in range(minute - width + 1, minute + 1):
                if start % slide == 0 and START + timedelta(minutes=start + width) <= until:
                    key = width, START + timedelta(minutes=start), module
                    n, good, times = out.get(key, (0, 0, []))
                    out[key] = n + 1, good + ok, times + ([] if ms is None else [ms])
    return {k: (n, good, round(sum(t) / len(t), 6) if t else None, min(t, default=None),
                max(t, default=None)) for k, (n, good, t) in out.items()}


def test_windows_of_all_sizes_are_written_once(spark):
    rng = random.Random(4)
    source, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    progress = scratch_path(spark, "progress")
    kept = StateTable(spark, scratch_path(spark, "panes"), rollups.PANES)
    seen = []
    for base, minute in enumerate([0, 20, 35, 90]):
        seen += rows(rng, base, 120, minute)
        spark.createDataFrame(seen[-120:], schemas.ROUTING_LOG).repartition(3).write.mode(
            "append").parquet(source)
        query = sinks.drain(rollups.rollup_stream(
            spark.readStream.schema(schemas.ROUTING_LOG).parquet(source), kept, out, progress,
            SIZES, delay="30 minutes"))
    passed = max(r[1] for r in seen) - timedelta(minutes=30)
    ends = {r[1].replace(second=0) + timedelta(minutes=1) for r in seen}
    until = max(end for end in ends if end <= passed)
    got = [((r.minutes, r.window_start, r.module_name), (
        r.total_requests, r.successful_requests,
        None if r.avg_response_time_ms is None else round(r.avg_response_time_ms, 6),
        r.min_response_time_ms, r.max_response_time_ms))
        for r in sinks.read_output(spark, out, rollups.OUT).collect()]
    assert len(got) == len(dict(got)), "each window once"
    assert dict(got) == counted(seen, until)
    assert len(query.lastProgress["stateOperators"]) == 1, "one stateful aggregate for all sizes"
    assert kept.read().select("pane").distinct().count() <= 13


def test_windows_of_an_empty_table(spark):
    empty = rollups.panes(spark.createDataFrame([], schemas.ROUTING_LOG))
    assert rollups.windows(empty, None, START).count() == 0
