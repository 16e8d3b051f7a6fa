"""Settings, selection and routing examples."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from relaylens.functions import clock, config as settings, selection
from relaylens.functions.hashing import uniform
from relaylens.operators import cooldown, quality, routing, stages


def test_instance_settings_win_even_when_null(spark):
    row = spark.sql("""SELECT map('a', '1', 'b', '2') AS g,
                              map('b', CAST(NULL AS STRING), 'c', '3') AS i""")
    merged = row.select(settings.effective(F.col("g"), F.col("i")).alias("m")).first().m
    assert merged == {"a": "1", "b": None, "c": "3"}


def test_coerce(spark):
    cases = [("Yes", "boolean"), ("maybe", "boolean"), ("12", "integer"), ("1.5", "integer"),
             ("1.5", "number"), ("x", "number"), ('["a", 1]', "array"), ("{", "object"),
             ("t", "string")]
    rows = spark.createDataFrame(cases, "raw STRING, kind STRING")
    got = [r.c for r in rows.select(settings.coerce(F.col("raw"), F.col("kind")).alias("c")).collect()]
    assert [g.boolean for g in got[:2]] == [True, False]
    assert got[2].integer == 12 and got[3].integer is None and got[3].text == "1.5"
    assert got[4].number == 1.5 and got[5].text == "x"
    assert got[6].json == '["a",1]' and got[7].text == "{" and got[8].text == "t"


def test_prompt_length_boundaries(spark):
    rows = spark.createDataFrame(
        [(300, "300", "s", "l"), (301, "300", "s", "l"), (1000, None, "s", "l"),
         (1001, None, "s", "l"), (1, "300", "s", None), (1, "300", "", "l"), (1, "abc", "s", "l")],
        "n INT, threshold STRING, under STRING, over STRING")
    got = [r[0] for r in rows.select(routing.prompt_length_target(
        F.col("n"), F.col("threshold"), F.col("under"), F.col("over"))).collect()]
    assert got == ["s", "l", "s", "l", None, None, None]


def test_free_tier_branches(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")],
                                     "request_id INT, model_name STRING")
    cooling = spark.createDataFrame(
        [("a-free", datetime(2024, 1, 2)), ("b-free", datetime(2024, 1, 1))],
        "model_key STRING, cooldown_until TIMESTAMP_NTZ")
    at = "2024-01-01 00:00:00"
    run = lambda fb: {r.model_name: r.target_model for r in
                      cooldown.route_free_tier(requests, cooling, at, fb).collect()}
    assert run(True) == {"a": "a-paid", "b": "b-free", "c": "c-free"}
    assert run(False) == {"a": None, "b": "b-free", "c": "c-free"}


def test_next_reset_before_at_and_after_the_hour(spark):
    rows = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 05:59:59'),
        (TIMESTAMP_NTZ '2024-01-01 06:00:00'), (TIMESTAMP_NTZ '2024-03-10 12:00:00') AS t(ts)""")
    utc = [r[0] for r in rows.select(clock.next_reset(F.col("ts"), 6)).collect()]
    assert utc == [datetime(2024, 1, 1, 6), datetime(2024, 1, 2, 6), datetime(2024, 3, 11, 6)]
    local = [r[0] for r in rows.select(
        clock.next_reset(F.col("ts"), 6, "America/New_York")).collect()]
    assert local[2] == datetime(2024, 3, 11, 10)  # summer time began


def test_selection_frequencies(spark):
    pool = F.expr("array(named_struct('model', 'a', 'score', 0.6D, 'cost', 1D), named_struct("
                  "'model', 'b', 'score', 0.3D, 'cost', 4D), named_struct('model', 'c', 'score', "
                  "CAST(NULL AS DOUBLE), 'cost', 1D))")
    rows = spark.range(20_000)
    u, u2 = uniform(F.col("id")), uniform(F.col("id"), "x")

    def shares(choice):
        counts = Counter(r[0] for r in rows.select(choice).collect())
        return {k: v / 20_000 for k, v in counts.items()}

    def near(got, want):
        assert all(abs(got.get(k, 0) - v) < 0.015 for k, v in want.items()), got

    near(shares(selection.weighted(pool, u)), {"a": 0.6 / 0.91, "b": 0.3 / 0.91, "c": 0.01 / 0.91})
    near(shares(selection.top_k(pool, F.lit(2), u)), {"a": 0.5, "b": 0.5, "c": 0})
    near(shares(selection.top_k(pool, F.lit(99), u)), {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    near(shares(selection.epsilon_greedy(pool, F.lit(0.3), u2, u)), {"a": 0.8, "b": 0.1, "c": 0.1})
    near(shares(selection.cold_start(pool, F.lit("cost_weighted"), u)),
         {"a": 4 / 9, "b": 1 / 9, "c": 4 / 9})
    empty = F.slice(pool, 1, 0)
    assert spark.range(1).select(selection.weighted(empty, F.lit(0.5)), selection.top_k(
        empty, F.lit(1), F.lit(0.5))).first() == (None, None)


def test_scores(spark):
    log = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), "m-opus", 3000.0, h != 1) for h in (1, 2, 3, 4)],
        "ts TIMESTAMP_NTZ, target_model STRING, response_time_ms DOUBLE, success BOOLEAN")
    pool = spark.createDataFrame(
        [("m-opus", "quality"), ("m-opus", "latency_quality_ratio"),
         ("m-opus", "quality_cost_ratio"), ("unseen", "quality")],
        "candidate_model STRING, scoring_metric STRING")
    got = {(r.candidate_model, r.scoring_metric): round(r.score, 6) for r in
           quality.assess_models(log, pool, "2024-01-01 12:00:00").collect()}
    assert got == {("m-opus", "quality"): 0.75, ("m-opus", "latency_quality_ratio"): 0.825,
                   ("m-opus", "quality_cost_ratio"): 0.68, ("unseen", "quality"): 0.5}


def test_merge_of_header_columns(spark):
    row = spark.sql("SELECT map('a', '1', 'b', '2') x, map('b', '3') y, "
                    "CAST(NULL AS MAP<STRING,STRING>) z")
    got = row.select(stages.merge_map_columns(F.col("x"), F.col("y"), F.col("z")).alias("m"),
                     stages.merge_map_columns(F.col("z")).alias("n")).first()
    assert got.m == {"a": "1", "b": "3"} and got.n is None
