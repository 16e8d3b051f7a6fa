"""Live assessments against a full cycle over all rows so far, and what a cycle reads."""

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relaylens.operators import quality
from relaylens.session import scratch_path
from relaylens.sources import schemas
from relaylens.sources.state_table import StateTable
from relaylens.streaming import assessments, sinks

START = datetime(2024, 3, 1, 0, 3, 7)
RULES = [("r1", "quality", True, 1, '{"models": ["a", "b", "never"], "scoring_metric": "success_rate"}'),
         ("r2", "quality", True, 1, '{"models": ["b", "c"], "scoring_metric": "latency_quality_ratio"}')]


def rows(rng, base, n, minutes):
    return [(base * 1000 + i, START + timedelta(minutes=minutes, seconds=rng.randint(-4000, 4000)),
             "m", "mod", rng.choice(["a", "b", "c", None]),
             None if rng.random() < 0.2 else float(rng.randint(1, 40_000)), rng.random() < 0.7, None)
            for i in range(n)]


def scores(weights):
    return {(r.rule_model_name, r.candidate_model): (round(r.score, 9), r.last_assessed_at)
            for r in weights.collect()}


def test_every_cycle_equals_one_over_the_whole_log(spark):
    rng = random.Random(3)
    rules = spark.createDataFrame(RULES, schemas.ROUTING_RULES)
    source, progress = scratch_path(spark, "log"), scratch_path(spark, "progress")
    recent = assessments.RecentLog(spark, scratch_path(spark, "recent"), schemas.ROUTING_LOG)
    weights = StateTable(spark, scratch_path(spark, "weights"), schemas.QUALITY_WEIGHTS)
    seen, forgotten = [], 0
    # the third batch is older than the second, the fifth and sixth leave the first days behind
    for base, minutes in enumerate([0, 700, 300, 1500, 3100, 3900]):
        seen += rows(rng, base, 150, minutes)
        part = spark.createDataFrame(seen[-150:] + [(base, None, "m", "mod", "a", 1.0, True, None)],
                                     schemas.ROUTING_LOG)
        part.repartition(3).write.mode("append").parquet(source)
        sinks.drain(assessments.assess_schedule(
            spark.readStream.schema(schemas.ROUTING_LOG).parquet(source), recent, rules, weights,
            progress, every=None))
        now = max(r[1] for r in seen)
        whole = spark.createDataFrame(seen, schemas.ROUTING_LOG)
        expected = quality.assessment_cycle(
            rules, whole, spark.createDataFrame([], schemas.QUALITY_WEIGHTS), now)
        assert scores(weights.read()) == scores(expected)
        in_window = sorted(r[0] for r in seen if r[1] > now - timedelta(hours=24))
        assert sorted(r.event_id for r in recent.rows(now).collect()) == in_window
    kept = {int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{recent._path}/batch=*")}
    assert kept == {4, 5}, "older batches have no row in the window"
    assert recent.panes.read().count() <= 4 * (24 * 6 + 1)
    assert weights.read().agg(F.max("assessment_count")).first()[0] == 6


def test_a_repeated_batch_counts_once(spark):
    recent = assessments.RecentLog(spark, scratch_path(spark, "recent"), schemas.ROUTING_LOG)
    batch = spark.createDataFrame(rows(random.Random(1), 0, 80, 0), schemas.ROUTING_LOG)
    now = recent.add(batch, 0)
    again = recent.add(batch, 0)
    assert now == again and recent.panes.read().agg(F.sum("total")).first()[0] == 80
    assert recent.rows(now).count() == 80
    nothing = batch.filter("false")
    assert recent.add(nothing, 1) == now, "the clock stays"
    assert recent.panes.read().agg(F.sum("total")).first()[0] == 80


def test_nothing_seen_yet(spark):
    recent = assessments.RecentLog(spark, scratch_path(spark, "recent"), schemas.ROUTING_LOG)
    assert recent.add(spark.createDataFrame([], schemas.ROUTING_LOG), 0) is None


def test_the_edge_pane_alone_is_read_from_rows(spark):
    recent = assessments.RecentLog(spark, scratch_path(spark, "recent"), schemas.ROUTING_LOG)
    rng = random.Random(8)
    for version, minutes in enumerate([0, 400, 900, 1300]):
        now = recent.add(spark.createDataFrame(rows(rng, version, 200, minutes),
                                               schemas.ROUTING_LOG), version)
    plan = recent.measured(now)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pane" in plan.replace("\n", " ")
    whole = recent.rows(now).groupBy("target_model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("response_time_ms").alias("ms")).collect()
    got = {r.candidate_model: (r._total, r._ms) for r in recent.measured(now).select(
        "candidate_model", "_total", "_ms").collect()}
    assert got == {r.target_model: (r.n, pytest.approx(r.ms)) for r in whole}
