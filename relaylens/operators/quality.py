"""Scoring models from their history and keeping the weight table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from relaylens.functions import clock, config as settings, selection
from relaylens.operators import state

NEUTRAL_SCORE = 0.5
LATENCY_CEILING_S = 30.0
COST_CEILING = 20.0
MISSING_LATENCY_MS = 1000.0
LIVE_ENGINES = ("self_consistency", "llm_judge", "reward_model")  # need a model to call

WEIGHT_POLICIES = {"score": state.OVERWRITE, "last_assessed_at": state.OVERWRITE,
                   "assessment_count": state.INCREMENT}


def model_costs(models: DataFrame, prices: DataFrame | None = None,
                column: str = "candidate_model") -> DataFrame:
    """Cost per 1k tokens: from an optional price table ``(model, price)``, else by name."""
    guess = selection.estimated_cost(F.col(column))
    if prices is None:
        return models.withColumn("cost", guess)
    table = prices.select(F.col("model").alias(column), "price")
    return (models.join(table, column, "left")
            .withColumn("cost", F.coalesce("price", guess)).drop("price"))


def _score(metric: Column, success: Column, latency_ms: Column, cost: Column) -> Column:
    seconds = F.when(F.coalesce(latency_ms, F.lit(0.0)) == 0, F.lit(MISSING_LATENCY_MS)
                     ).otherwise(latency_ms) / 1000
    speed = F.greatest(F.lit(0.0), 1 - seconds / LATENCY_CEILING_S)
    thrift = F.greatest(F.lit(0.0), 1 - cost / COST_CEILING)
    return (F.when(metric == "latency_quality_ratio", (success + speed) / 2)
            .when(metric == "quality_cost_ratio", success * 0.6 + speed * 0.2 + thrift * 0.2)
            .otherwise(success))


def assess_models(log: DataFrame, pool: DataFrame, as_of, hours: float = 24,
                  prices: DataFrame | None = None) -> DataFrame:
    """``pool(candidate_model, scoring_metric, ...)`` with a ``score`` in [0, 1].

    All candidates are measured by one aggregate of the log window; the measured table has one
    row per model and is joined to the pool.
    """
    window = log.filter((F.col("ts") > clock.shifted(as_of, hours=-hours))
                        & (F.col("ts") <= clock.instant(as_of)))
    return rated(pool, window.groupBy(F.col("target_model").alias("candidate_model")).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if("success").alias("_good"),
        F.avg("response_time_ms").alias("_ms")), prices)


def rated(pool: DataFrame, measured: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Scores from the calls, successes and mean latency of each candidate."""
    costed = model_costs(pool.join(measured, "candidate_model", "left"), prices)
    score = _score(F.col("scoring_metric"), F.col("_good") / F.col("_total"), F.col("_ms"),
                   F.col("cost"))
    return (costed.withColumn("score", F.when(F.col("_total").isNull(), F.lit(NEUTRAL_SCORE))
                             .otherwise(score))
            .drop("_total", "_good", "_ms", "cost"))


JUDGES: dict[str, Callable[..., DataFrame]] = {}


def register_judge(name: str, judge: Callable[..., DataFrame]) -> None:
    """``judge(log, pool, as_of) -> pool with score``; the score must lie in [0, 1]."""
    JUDGES[name] = judge


register_judge("response_metrics", assess_models)
register_judge("hybrid", assess_models)  # no other engine can run without live inference


def rule_pools(rules: DataFrame, module: str = "quality") -> DataFrame:
    """One row per enabled rule and candidate, in list order, with the rule's settings."""
    chosen = rules.filter(F.col("enabled") & (F.col("module_name") == module))
    config = settings.parse(F.col("instance_config"))
    models = F.from_json(F.get_json_object("instance_config", "$.models"), "ARRAY<STRING>")
    return chosen.select(
        F.col("model_name").alias("rule_model_name"),
        F.coalesce(config["judge_engine"], F.lit("response_metrics")).alias("judge_engine"),
        F.coalesce(config["scoring_metric"], F.lit("quality_cost_ratio")).alias("scoring_metric"),
        F.posexplode(models).alias("pos", "candidate_model"))


def assess_rules(rules: DataFrame, log: DataFrame, as_of, module: str = "quality",
                 measured: DataFrame | None = None) -> DataFrame:
    """Scores of all candidates of all rules, by the engine each rule names.

    With ``measured`` the bundled engine takes the window's figures from there, not from the log.

    An unknown engine falls back to the bundled one; rules of an engine that needs live
    inference are left out. The set of engines is fixed when the plan is built.
    """
    pool = rule_pools(rules, module)
    known = [*JUDGES, *[e for e in LIVE_ENGINES if e not in JUDGES]]
    engine = F.when(F.col("judge_engine").isin(*known), F.col("judge_engine")
                    ).otherwise(F.lit("response_metrics"))
    pool = pool.withColumn("judge_engine", engine)
    by_function: dict[Callable, list[str]] = {}
    for name, judge in JUDGES.items():
        by_function.setdefault(judge, []).append(name)
    scored = None
    for judge, names in by_function.items():
        own = pool.filter(F.col("judge_engine").isin(*names))
        kept = measured is not None and judge is assess_models
        part = rated(own, measured) if kept else judge(log, own, as_of)
        scored = part if scored is None else scored.unionByName(part)
    return scored


def assessment_cycle(rules: DataFrame, log: DataFrame, weights: DataFrame, as_of,
                     module: str = "quality", measured: DataFrame | None = None) -> DataFrame:
    """The weight table after one assessment of every rule."""
    fresh = (assess_rules(rules, log, as_of, module, measured)
             .select("rule_model_name", "candidate_model", "score", "pos")
             .withColumn("last_assessed_at", clock.instant(as_of)))
    return update_weights(weights, fresh, ["pos"])


def update_weights(weights: DataFrame, scores: DataFrame, order: list[str]) -> DataFrame:
    """Upsert scores; the count grows by one per assessment."""
    return state.keyed_upsert(weights, scores, ["rule_model_name", "candidate_model"],
                              WEIGHT_POLICIES, order)


def ranked(weights: DataFrame) -> DataFrame:
    """Rank of every candidate inside its rule (a pool is one array of a rule's config)."""
    best_first = W.partitionBy("rule_model_name").orderBy(F.desc("score"))
    return weights.withColumn("rank", F.rank().over(best_first))


def for_rule(weights: DataFrame, rule: str) -> DataFrame:
    return weights.filter(F.col("rule_model_name") == rule).orderBy(
        F.desc("score"), "candidate_model")


def fresh(weights: DataFrame, as_of, interval_minutes: float = 60) -> DataFrame:
    """Weights younger than two assessment intervals; older ones mean cold start."""
    return weights.filter(
        F.col("last_assessed_at") > clock.shifted(as_of, mins=-2 * interval_minutes))
