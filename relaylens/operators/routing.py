"""Routing decisions over a log of requests."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from relaylens.functions import clock, config as settings, selection
from relaylens.functions.hashing import uniform
from relaylens.operators import config, cooldown, quality

logger = logging.getLogger(__name__)

FREE_TIER, PROMPT_LENGTH, QUALITY = "free_tier", "prompt_length", "quality"
GLOBAL_KEYS = ["threshold", "model_under", "model_over", "fallback_enabled",
               "selection_strategy", "cold_start_strategy", "top_k", "epsilon"]
COOLDOWN_KEYS = ["cooldown_reset_hour", "cooldown_timezone"]


def all_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumn(
        "instance_config", F.coalesce("instance_config", F.lit("{}"))
    ).orderBy(F.desc("priority"), "model_name")


def active_rules(rules: DataFrame) -> DataFrame:
    return all_rules(rules.filter("enabled"))


def best_rules(rules: DataFrame) -> DataFrame:
    """The enabled rule of highest priority per model; one row per model."""
    fields = ["module_name", "priority", "instance_config"]
    return rules.filter("enabled").groupBy("model_name").agg(F.max_by(
        F.struct(*fields), F.struct("priority", "module_name")).alias("rule")).select(
        "model_name", "rule.*")


def match_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with the module, priority and config of their rule, or nulls.

    The join never multiplies rows. Spark broadcasts the rules when they are below its
    threshold; otherwise AQE splits hot models.
    """
    return requests.join(best_rules(rules), "model_name", "left").select(
        *requests.columns, "module_name", "priority", "instance_config")


def effective_settings(matched: DataFrame, module_configs: DataFrame,
                       keys: list[str] = GLOBAL_KEYS) -> DataFrame:
    """The named settings as text columns: the rule's own value, else the module's.

    An instance key counts even when its value is null.
    """
    wide = config.config_wide(module_configs, keys).select(
        "module_name", *[F.col(k).alias(f"_global_{k}") for k in keys])
    own = settings.parse(F.col("instance_config"))
    return matched.join(wide, "module_name", "left").withColumns({
        key: F.when(F.map_contains_key(own, F.lit(key)), own[key]).otherwise(
            F.col(f"_global_{key}")) for key in keys}).drop(*[f"_global_{k}" for k in keys])


def prompt_length_target(length: Column, threshold: Column, under: Column,
                         over: Column) -> Column:
    """``under`` up to the threshold, ``over`` beyond it; null when either is missing."""
    set_up = (F.coalesce(under, F.lit("")) != "") & (F.coalesce(over, F.lit("")) != "")
    limit = F.when(threshold.isNull(), F.lit(1000)).otherwise(threshold.try_cast("bigint"))
    return F.when(set_up, F.when(length <= limit, under).when(length > limit, over))


def route_prompt_length(requests: DataFrame) -> DataFrame:
    """Requests with ``prompt_length`` and their effective settings."""
    return requests.withColumn("target_model", prompt_length_target(
        F.col("prompt_length"), F.col("threshold"), F.col("model_under"), F.col("model_over")))


def candidate_pools(rules: DataFrame, weights: DataFrame, prices: DataFrame | None = None,
                    as_of=None, interval_minutes: float = 60) -> DataFrame:
    """Per rule its candidates with score and cost as one array, and whether any has a weight.

    The array restores what was one array in the rule's config, so its size is that of a row.
    With ``as_of`` weights older than two assessment intervals do not count.
    """
    if as_of is not None:
        weights = quality.fresh(weights, as_of, interval_minutes)
    pool = quality.model_costs(quality.rule_pools(rules), prices).join(
        weights.select("rule_model_name", "candidate_model", "score"),
        ["rule_model_name", "candidate_model"], "left")
    ordered = F.array_sort(F.collect_list(F.struct(
        "pos", F.col("candidate_model").alias("model"), "score", "cost")))
    return pool.groupBy("rule_model_name").agg(
        F.transform(ordered, lambda c: F.struct(
            c["model"].alias("model"), c["score"].alias("score"),
            c["cost"].alias("cost"))).alias("pool"),
        (F.count("score") > 0).alias("scored"))


def draws(requests: DataFrame) -> DataFrame:
    """Two repeatable draws per request, as columns so that each is hashed once."""
    return requests.withColumns({"_u": uniform(F.col("request_id")),
                                 "_explore": uniform(F.col("request_id"), "explore")})


def quality_target() -> Column:
    """The choice for a row with ``draws``, a prepared pool and the effective settings."""
    ready, u = F.col("_ready"), F.col("_u")
    chosen = selection.by_strategy(
        ready, F.coalesce("selection_strategy", F.lit("weighted_random")),
        F.coalesce(F.col("top_k").try_cast("int"), F.lit(1)),
        F.coalesce(F.col("epsilon").try_cast("double"), F.lit(0.1)), u, F.col("_explore"))
    fallback = selection.start_cold(
        ready, F.coalesce("cold_start_strategy", F.lit("cost_weighted")), u)
    return F.when(F.col("scored"), chosen).otherwise(fallback)


def ready_pools(pools: DataFrame) -> DataFrame:
    """``candidate_pools`` with all that a choice looks up, worked out once per rule."""
    return pools.select(F.col("rule_model_name").alias("model_name"),
                        selection.prepared(F.col("pool")).alias("_ready"), "scored")


def route_quality(requests: DataFrame, pools: DataFrame) -> DataFrame:
    """Requests with their effective settings; models without a pool get null."""
    joined = draws(requests).join(ready_pools(pools), "model_name", "left")
    return joined.withColumn("target_model", quality_target()).drop(
        "_ready", "scored", "_u", "_explore")


def rule_cards(rules: DataFrame, module_configs: DataFrame, weights: DataFrame,
               breakers: DataFrame) -> DataFrame:
    """All that a decision needs to know about a model, one row per model with a rule.

    Settings are parsed and merged, and pools and recovery times attached, once per rule instead
    of once per request; none of these joins touches the request table.
    """
    gates = breakers.select("module_name", F.col("recovery_timeout").alias("_recovery"))
    pools = ready_pools(candidate_pools(rules, weights))
    return (effective_settings(best_rules(rules), module_configs, GLOBAL_KEYS + COOLDOWN_KEYS)
            .join(gates, "module_name", "left").join(pools, "model_name", "left"))


def reset_of(ts: Column) -> Column:
    """The next reset after ``ts`` by the settings of the row; hour 0 and UTC without them."""
    hour = F.coalesce(F.col("cooldown_reset_hour").try_cast("int"), F.lit(0))
    return clock.next_reset(ts, hour, F.coalesce("cooldown_timezone", F.lit("UTC")))


def cooldown_periods(errors: DataFrame, rules: DataFrame, module_configs: DataFrame) -> DataFrame:
    """Per key and reset period the first error, with the reset hour and zone that the settings
    of the key's rule give; keys without a rule reset at midnight UTC."""
    settings_of = effective_settings(best_rules(rules), module_configs, COOLDOWN_KEYS).select(
        F.concat("model_name", F.lit(cooldown.FREE)).alias("model_key"), *COOLDOWN_KEYS)
    timed = errors.join(settings_of, "model_key", "left").withColumn(
        "cooldown_until", reset_of(F.col("ts")))
    return timed.groupBy("model_key", "cooldown_until").agg(
        F.min(F.struct("ts", "event_id")).alias("first_error"))


def time_slot(ts: Column, seconds: Column) -> Column:
    """The number of the stretch of ``seconds`` in which ``ts`` lies."""
    return F.floor(F.unix_micros(ts.cast("timestamp"))
                   / (F.greatest(seconds, F.lit(1)).cast("bigint") * 1_000_000)).cast("bigint")


def slotted(blocked: DataFrame, breakers: DataFrame) -> DataFrame:
    """(_module, _slot, _blocked): the blocked periods that touch a slot of recovery time.

    A period is no longer than the recovery time, so it touches two slots at most, and looking
    up a request's slot is an equi-join with one right row at most.
    """
    own = blocked.join(breakers.select("module_name", "recovery_timeout"), "module_name")
    ends = F.array_distinct(F.array(time_slot(F.col("blocked_from"), F.col("recovery_timeout")),
                                    time_slot(F.col("blocked_until"), F.col("recovery_timeout"))))
    return own.withColumn("_slot", F.explode(ends)).groupBy(
        F.col("module_name").alias("_module"), "_slot").agg(
        F.collect_list(F.struct("blocked_from", "blocked_until")).alias("_blocked"))


def switchboard(requests: DataFrame, rules: DataFrame, module_configs: DataFrame,
                weights: DataFrame, errors: DataFrame, breakers: DataFrame,
                blocked: DataFrame) -> DataFrame:
    """The whole chain for requests ``(request_id, ts, model_name, prompt_length)``.

    match rule -> merge settings -> breaker gate -> the module's own decision, all as of the
    time of each request. The request table takes part in three equi-joins, to the rule cards,
    to the cooldown periods and to the blocked periods of the breakers. All right sides have
    one row per key, so it keeps its size, and one ``case`` picks the branch. Spark broadcasts
    what is below its threshold and joins the rest by shuffle, where AQE splits hot keys.

    ``breakers`` holds ``(module_name, recovery_timeout)``, ``blocked`` the result of
    ``breaker.blocked_periods`` for the same modules.
    """
    cards = rule_cards(rules, module_configs, weights, breakers)
    started = cooldown_periods(errors, rules, module_configs).select(
        F.col("model_key").alias("_key"), F.col("cooldown_until").alias("_reset"), "first_error")
    carded = draws(requests).join(cards, "model_name", "left").withColumns({
        "_key": F.concat("model_name", F.lit(cooldown.FREE)), "_reset": reset_of(F.col("ts")),
        "_module": F.col("module_name"),
        "_slot": time_slot(F.col("ts"), F.col("_recovery"))})
    rows = carded.join(started, ["_key", "_reset"], "left").join(
        slotted(blocked, breakers), ["_module", "_slot"], "left")
    blocked = F.coalesce(F.exists("_blocked", lambda p: (F.col("ts") >= p["blocked_from"])
                                  & (F.col("ts") < p["blocked_until"])), F.lit(False))
    cooling = F.coalesce(F.col("first_error") < F.struct(
        F.col("ts"), F.col("request_id").alias("event_id")), F.lit(False))
    fallback = F.lower(F.coalesce("fallback_enabled", F.lit("true"))) == "true"
    module = F.col("module_name")
    decided = (
        F.when(module == FREE_TIER, cooldown.free_tier_target(
            F.col("model_name"), cooling, fallback))
        .when(module == PROMPT_LENGTH, prompt_length_target(
            F.col("prompt_length"), F.col("threshold"), F.col("model_under"),
            F.col("model_over")))
        .when(module == QUALITY, quality_target()))
    return rows.select(
        "request_id", "ts", "model_name", "module_name", blocked.alias("blocked"),
        F.when(~blocked, decided).alias("target_model"))


def metric_target() -> Column:
    return F.when(F.col("blocked"), F.lit("circuit_breaker_open")).otherwise(
        F.coalesce("target_model", F.lit("default")))


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """The metric row of every request that had a rule."""
    opened = F.concat(F.lit("Circuit breaker "), "module_name", F.lit(" is OPEN"))
    return decisions.filter(F.col("module_name").isNotNull()).select(
        "request_id", "ts", "model_name", "module_name", metric_target().alias("target_model"),
        (~F.col("blocked")).alias("success"),
        F.when(F.col("blocked"), opened).alias("error_message"))


class RouteRegistry:
    """User strategies: name -> function from a request row's columns to a target column.

    A strategy is called once, when the plan is built, with the request frame; it returns a
    Column (a ``pandas_udf`` result is fine). One that raises is skipped and decides null.
    """

    def __init__(self):
        self._routes: dict[str, Callable[[DataFrame], Column]] = {}

    def register(self, name: str, route: Callable[[DataFrame], Column]) -> None:
        self._routes[name] = route

    def route(self, requests: DataFrame) -> DataFrame:
        """``requests`` carry ``module_name``; unknown modules get null."""
        target = F.lit(None).cast("string")
        for name, build in self._routes.items():
            try:
                column = build(requests).cast("string")
            except Exception as error:
                logger.error("route %s failed: %s", name, error)
                continue
            target = F.when(F.col("module_name") == name, column).otherwise(target)
        return requests.withColumn("target_model", target)
