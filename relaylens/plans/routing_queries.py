"""Queries over rules, settings, routing decisions and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.functions import config as settings, selection
from relaylens.operators import config, cooldown, quality, routing, stages
from relaylens.plans import frames
from relaylens.plans.registry import query

NOON = "2024-01-15 12:00:00"
_RULES = """model_name, module_name, enabled, priority,
    COALESCE(instance_config, '{{}}') AS instance_config"""


@query("rules_active", f"SELECT {_RULES} FROM {{routing_rules}} WHERE enabled")
def rules_active(t):
    return routing.active_rules(t.routing_rules)


@query("rules_all", f"SELECT {_RULES} FROM {{routing_rules}}")
def rules_all(t):
    return routing.all_rules(t.routing_rules)


@query("route_match", """
    SELECT t.request_id, t.model_name, r.module_name, r.priority
    FROM {traffic} t LEFT JOIN {routing_rules} r ON r.model_name = t.model_name AND r.enabled""")
def route_match(t):
    return routing.match_rule(t.traffic, t.routing_rules).select(
        "request_id", "model_name", "module_name", "priority")


@query("config_map", """
    SELECT module_name, COUNT(DISTINCT config_key) AS n,
           STRING_AGG(config_key || '=' || config_value, ';' ORDER BY config_key) AS settings
    FROM {module_configs} GROUP BY module_name""")
def config_map(t):
    maps = config.config_map(t.module_configs)
    entries = F.transform(F.map_entries("config"),
                          lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("module_name", F.size("config").cast("bigint").alias("n"),
                       F.array_join(entries, ";").alias("settings"))


@query("config_effective", """
    SELECT model_name, key,
           CASE WHEN json_exists(own, '$.' || key) THEN own->>('$.' || key) ELSE general END AS value
    FROM (
      SELECT r.model_name, COALESCE(r.instance_config, '{{}}') AS own, k.key, c.config_value AS general
      FROM {routing_rules} r
      CROSS JOIN (SELECT UNNEST(['threshold', 'model_under', 'model_over', 'fallback_enabled',
        'cooldown_reset_hour', 'selection_strategy', 'top_k', 'scoring_metric']) AS key) k
      LEFT JOIN {module_configs} c ON c.module_name = r.module_name AND c.config_key = k.key) x
    WHERE json_exists(own, '$.' || key) OR general IS NOT NULL""")
def config_effective(t):
    maps = config.config_map(t.module_configs)
    merged = settings.effective(F.col("config"), settings.parse(F.col("instance_config")))
    return (t.routing_rules.join(maps, "module_name", "left")
            .select("model_name", F.explode(merged).alias("key", "value"))
            .filter(F.col("key") != "models"))


_KIND = """CASE WHEN module_name LIKE 'module-%' THEN CASE CAST(SUBSTR(module_name, 8) AS INT) % 3
               WHEN 0 THEN 'free_tier' WHEN 1 THEN 'prompt_length' ELSE 'quality' END
           ELSE module_name END"""


def _kinds(t):
    """Modules of the log by their number: a third of them each under one of three schemas."""
    return t.routing_modules.withColumn("kind", F.expr(_KIND))


@query("config_coerce", f"""
    SELECT module_name, config_key,
           CASE WHEN kind = 'free_tier' AND config_key = 'fallback_enabled'
             THEN LOWER(config_value) IN ('true', '1', 'yes', 'on') END AS boolean_value,
           CASE WHEN kind || '.' || config_key IN ('prompt_length.threshold',
                                                   'free_tier.cooldown_reset_hour')
             THEN TRY_CAST(config_value AS BIGINT) END AS integer_value,
           CASE WHEN kind = 'quality' AND config_key = 'epsilon'
             THEN TRY_CAST(config_value AS DOUBLE) END AS number_value,
           CASE WHEN kind = 'quality' AND config_key = 'models'
             THEN CAST(CAST(REPLACE(config_value, '", "', '","') AS JSON) AS VARCHAR) END AS json_value,
           CASE WHEN kind || '.' || config_key NOT IN ('free_tier.fallback_enabled',
                  'prompt_length.threshold', 'free_tier.cooldown_reset_hour', 'quality.models',
                  'quality.epsilon')
                OR (kind = 'quality' AND config_key = 'epsilon'
                    AND TRY_CAST(config_value AS DOUBLE) IS NULL) THEN config_value END AS text_value
    FROM (SELECT *, {_KIND} AS kind FROM {{module_configs}}) c""")
def config_coerce(t):
    return config.coerce_rows(t.module_configs, config.schema_table(t.spark), _kinds(t)).drop(
        "config_value")


@query("config_defaults", f"""
    SELECT module_name, k.config_key, COALESCE(c.config_value, k.default_value) AS value,
           c.config_value IS NULL AS defaulted,
           CASE WHEN k.config_key = 'cooldown_reset_hour' AND c.config_value IS NOT NULL
                THEN CAST(c.config_value AS INT) BETWEEN 0 AND 23
                WHEN k.config_key = 'epsilon' AND c.config_value IS NOT NULL
                THEN TRY_CAST(c.config_value AS DOUBLE) IS NOT NULL ELSE true END AS valid
    FROM (SELECT module_name, {_KIND} AS kind FROM {{routing_modules}}) m
    JOIN (VALUES {', '.join(
        "('" + kind + "', '" + key + "', " + ("NULL" if value is None else "'" + value + "'") + ")"
        for kind, key, _, value, *_ in config.SCHEMA_ROWS)}) AS k(kind, config_key, default_value)
      USING (kind)
    LEFT JOIN {{module_configs}} c USING (module_name, config_key)""")
def config_defaults(t):
    return config.with_defaults(_kinds(t), t.module_configs, config.schema_table(t.spark))


@query("route_prompt_length", """
    SELECT r.request_id, CASE WHEN x.instance_config LIKE '%model_over%'
      THEN CASE WHEN COALESCE(LENGTH_SUM, 0) <= 1500 THEN 'small' ELSE 'large' END END
      AS target_model
    FROM {requests} r
    JOIN {routing_rules} x ON x.model_name = r.model_name AND x.enabled
      AND x.module_name = 'prompt_length'
    LEFT JOIN (SELECT request_id, SUM(LENGTH(text)) AS LENGTH_SUM FROM {message_texts}
               GROUP BY request_id) m ON m.request_id = r.request_id""")
def route_prompt_length(t):
    matched = routing.match_rule(frames.prompts(t), t.routing_rules).filter(
        F.col("module_name") == routing.PROMPT_LENGTH)
    return routing.route_prompt_length(
        routing.effective_settings(matched, t.module_configs)).select("request_id", "target_model")


@query("route_free_tier", """
    SELECT request_id, CASE WHEN c.model_key IS NULL THEN model_name || '-free'
           ELSE model_name || '-paid' END AS target_model,
           CASE WHEN c.model_key IS NULL THEN model_name || '-free' END AS target_no_fallback
    FROM {traffic} t LEFT JOIN {cooldowns} c ON c.model_key = t.model_name || '-free'
     AND c.cooldown_until > {at}'2024-01-30 06:00:00'""")
def route_free_tier(t):
    as_of = "2024-01-30 06:00:00"
    with_fallback = cooldown.route_free_tier(t.traffic, t.cooldowns, as_of)
    return cooldown.route_free_tier(
        with_fallback.withColumnRenamed("target_model", "first"), t.cooldowns, as_of,
        fallback=False).select("request_id", F.col("first").alias("target_model"),
                               F.col("target_model").alias("target_no_fallback"))


@query("route_asof_cooldown", """
    SELECT request_id, model_name || CASE WHEN until > ts THEN '-paid' ELSE '-free' END
           AS target_model
    FROM (SELECT *, LAST_VALUE(event_until IGNORE NULLS) OVER (PARTITION BY model_name
            ORDER BY ts, id, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
          FROM (SELECT request_id, model_name, ts, request_id AS id, 0 AS kind,
                       CAST(NULL AS TIMESTAMP) AS event_until FROM {traffic}
                UNION ALL
                SELECT NULL, REPLACE(model_key, '-free', ''), ts, event_id, 1,
                       CASE WHEN EXTRACT(HOUR FROM ts) < 6
                         THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
                         ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR END
                FROM {rate_limit_events}) u) w
    WHERE kind = 0""")
def route_asof_cooldown(t):
    return cooldown.route_free_tier_replay(t.traffic, t.rate_limit_events, hour=6).select(
        "request_id", "target_model")


def _pooled(t):
    pools = routing.candidate_pools(t.routing_rules, t.weights)
    return routing.draws(t.traffic).join(
        pools.withColumnRenamed("rule_model_name", "model_name"), "model_name")


@query("select_weighted", "SELECT request_id, target_model FROM {weighted_picks}")
def select_weighted(t):
    return _pooled(t).select("request_id", selection.weighted(
        F.col("pool"), F.col("_u")).alias("target_model"))


@query("select_top_k", "SELECT request_id, target_model FROM {top_picks}")
def select_top_k(t):
    return _pooled(t).select("request_id", selection.top_k(
        F.col("pool"), F.lit(2), F.col("_u")).alias("target_model"))


@query("select_epsilon", """
    SELECT d.request_id, p.candidate_model AS target_model
    FROM {draws} d JOIN {best_of_pool} p ON d.model_name = p.rule_model_name
     AND CASE WHEN d.u_explore < 0.1 THEN p.pos = CAST(FLOOR(d.u * p.n) AS BIGINT)
              ELSE p.place = 0 END""")
def select_epsilon(t):
    return _pooled(t).select("request_id", selection.epsilon_greedy(
        F.col("pool"), F.lit(0.1), F.col("_explore"), F.col("_u")).alias("target_model"))


@query("select_cold_start", """
    SELECT request_id, c.target_model, p.candidate_model AS uniform_model
    FROM {cold_picks} c JOIN {draws} d USING (request_id)
    JOIN {pool_scores} p ON p.rule_model_name = d.model_name
     AND p.pos = CAST(FLOOR(d.u * p.n) AS BIGINT)""")
def select_cold_start(t):
    u = F.col("_u")
    return _pooled(t).select(
        "request_id",
        selection.cold_start(F.col("pool"), F.lit("cost_weighted"), u).alias("target_model"),
        selection.cold_start(F.col("pool"), F.lit("round_robin"), u).alias("uniform_model"))


@query("model_cost", """
    SELECT p_partkey, model, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice / 100
      WHEN model LIKE '%gpt-4o%' OR model LIKE '%opus%' THEN 15.0
      WHEN model LIKE '%gpt-4%' OR model LIKE '%sonnet%' THEN 3.0
      WHEN model LIKE '%haiku%' OR model LIKE '%gpt-3.5%' OR model LIKE '%mini%' THEN 0.25
      ELSE 1.0 END AS cost
    FROM (SELECT *, p_partkey || '-' || p_name || CASE p_size % 6 WHEN 0 THEN '-gpt-4o-mini'
            WHEN 1 THEN '-gpt-4' WHEN 2 THEN '-mini' WHEN 3 THEN '-sonnet' WHEN 4 THEN '-opus'
            ELSE '' END AS model FROM {part}) p""")
def model_cost(t):
    """A fifth of the models have a price in the table, the others go by their names."""
    size = F.col("p_size") % 6
    suffix = (F.when(size == 0, "-gpt-4o-mini").when(size == 1, "-gpt-4").when(size == 2, "-mini")
              .when(size == 3, "-sonnet").when(size == 4, "-opus").otherwise(""))
    models = t.part.select("p_partkey", F.concat(
        F.col("p_partkey").cast("string"), F.lit("-"), "p_name", suffix).alias("model"),
        (F.col("p_retailprice") / 100).alias("price"))
    prices = models.filter("p_partkey % 5 = 0").select("model", "price")
    return quality.model_costs(models.select("p_partkey", "model"), prices, column="model")


ROUTE_QUALITY = """
    SELECT d.request_id,
           CASE WHEN NOT q.scored THEN c.target_model WHEN q.strategy = 'top_k' THEN k.target_model
                ELSE w.target_model END AS target_model
    FROM {draws} d
    JOIN (SELECT DISTINCT rule_model_name, scored, strategy FROM {pool_scores}) q
      ON q.rule_model_name = d.model_name
    JOIN {weighted_picks} w USING (request_id) JOIN {top_picks} k USING (request_id)
    JOIN {cold_picks} c USING (request_id)"""


@query("route_quality", ROUTE_QUALITY)
def route_quality(t):
    matched = routing.match_rule(t.traffic, t.routing_rules).filter(
        F.col("module_name") == routing.QUALITY)
    ready = routing.effective_settings(matched, t.module_configs)
    pools = routing.candidate_pools(t.routing_rules, t.weights)
    return routing.route_quality(ready, pools).filter(
        F.col("target_model").isNotNull()).select("request_id", "target_model")


@query("route_quality_fresh", """
    SELECT request_id, MIN_BY(candidate_model, pos) FILTER (through > u * total) AS target_model
    FROM (SELECT d.request_id, d.u, p.candidate_model, p.pos,
                 SUM(1 / p.cost) OVER (PARTITION BY d.request_id ORDER BY p.pos) AS through,
                 SUM(1 / p.cost) OVER (PARTITION BY d.request_id) AS total
          FROM {draws} d JOIN {pool_scores} p ON d.model_name = p.rule_model_name
          WHERE p.rule_model_name NOT IN (
            SELECT q.rule_model_name FROM {rule_pools} q JOIN {weights} w
              USING (rule_model_name, candidate_model)
            WHERE w.last_assessed_at > {at}'2024-01-30 12:00:00')) x
    GROUP BY request_id""")
def route_quality_fresh(t):
    """Rules whose weights are all stale start cold; only their requests are listed."""
    pools = routing.candidate_pools(t.routing_rules, t.weights, as_of="2024-01-31 00:00:00",
                                    interval_minutes=360).filter("not scored")
    matched = routing.match_rule(t.traffic, t.routing_rules).filter(
        F.col("module_name") == routing.QUALITY)
    ready = routing.effective_settings(matched, t.module_configs)
    return routing.route_quality(ready, pools).filter(
        F.col("target_model").isNotNull()).select("request_id", "target_model")


@query("candidates_filter", """
    SELECT rule_model_name, STRING_AGG(candidate_model, ',' ORDER BY score DESC, pos) AS candidates
    FROM {pool_scores} WHERE score >= 0.7 AND candidate_model <> 'cand-9'
    GROUP BY rule_model_name""")
def candidates_filter(t):
    pools = routing.candidate_pools(t.routing_rules, t.weights)
    kept = selection.filter_candidates(
        F.col("pool"),
        [lambda c: selection.floored(c["score"]) >= 0.7, lambda c: c["model"] != "cand-9"],
        order=lambda c: -selection.floored(c["score"]))
    return pools.select("rule_model_name", F.array_join(
        F.transform(kept, lambda c: c["model"]), ",").alias("candidates")).filter(
        F.col("candidates") != "")


def quality_sql(metric, start="{at}'2024-01-14 12:00:00'", end="{at}'2024-01-15 12:00:00'"):
    return f"""SELECT candidate_model, '{metric}' AS scoring_metric, ROUND(CASE
        WHEN total IS NULL THEN 0.5
        WHEN '{metric}' = 'quality' THEN ok
        WHEN '{metric}' = 'latency_quality_ratio' THEN (ok + speed) / 2
        ELSE ok * 0.6 + speed * 0.2 + 0.95 * 0.2 END, 6) AS score
      FROM (SELECT DISTINCT candidate_model FROM {{rule_pools}}) c
      LEFT JOIN (SELECT target_model, COUNT(*) AS total,
                   AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS ok,
                   GREATEST(0, 1 - AVG(response_time_ms) / 1000 / 30) AS speed
                 FROM {{routing_log}} WHERE ts > {start} AND ts <= {end} GROUP BY target_model) l
        ON l.target_model = c.candidate_model"""


METRICS = ("quality", "latency_quality_ratio", "quality_cost_ratio")


@query("quality_score", " UNION ALL ".join(quality_sql(m) for m in METRICS))
def quality_score(t):
    models = quality.rule_pools(t.routing_rules).select("candidate_model").distinct()
    pool = models.withColumn("scoring_metric", F.explode(F.array(*map(F.lit, METRICS))))
    return quality.assess_models(t.routing_log, pool, NOON).withColumn(
        "score", F.round("score", 6))


@query("quality_cycle", f"""
    SELECT rule_model_name, candidate_model, ROUND(COALESCE(s.score, w.score), 6) AS score,
           CASE WHEN s.score IS NULL THEN w.last_assessed_at
                ELSE {{at}}'2024-01-15 12:00:00' END AS last_assessed_at,
           COALESCE(w.assessment_count, 0) + CASE WHEN s.score IS NULL THEN 0 ELSE 1 END
             AS assessment_count
    FROM {{weights}} w FULL OUTER JOIN (
      SELECT p.rule_model_name, p.candidate_model, q.score FROM {{rule_pools}} p
      JOIN ({' UNION ALL '.join(quality_sql(m) for m in METRICS)}) q
        USING (candidate_model, scoring_metric)) s USING (rule_model_name, candidate_model)""")
def quality_cycle(t):
    after = quality.assessment_cycle(t.routing_rules, t.routing_log, t.weights, NOON)
    return after.withColumn("score", F.round("score", 6))


@query("quality_rank", """
    SELECT rule_model_name, candidate_model, score,
           RANK() OVER (PARTITION BY rule_model_name ORDER BY score DESC) AS rank
    FROM {weights}""")
def quality_rank(t):
    return quality.ranked(t.weights).select(
        "rule_model_name", "candidate_model", "score", F.col("rank").cast("bigint").alias("rank"))


@query("quality_fresh", """
    SELECT rule_model_name, candidate_model FROM {weights}
    WHERE last_assessed_at > {at}'2024-01-28 00:00:00'""")
def quality_fresh(t):
    return quality.fresh(t.weights, "2024-01-30 00:00:00", 1440).select(
        "rule_model_name", "candidate_model")


@query("judge_plugin", """
    SELECT rule_model_name, candidate_model,
           ROUND(COALESCE(best, 0), 6) AS score FROM {rule_pools}
    LEFT JOIN (SELECT target_model AS candidate_model, 1 - MIN(response_time_ms) / 50000 AS best
               FROM {routing_log} GROUP BY target_model) l USING (candidate_model)""")
def judge_plugin(t):
    def fastest_call(log, pool, as_of):
        best = log.groupBy(F.col("target_model").alias("candidate_model")).agg(
            (1 - F.min("response_time_ms") / 50000).alias("best"))
        return pool.join(best, "candidate_model", "left").withColumn(
            "score", F.coalesce("best", F.lit(0.0))).drop("best")

    quality.register_judge("fastest_call", fastest_call)
    engine = F.regexp_replace("instance_config", r"\}$", ',"judge_engine":"fastest_call"}')
    rules = t.routing_rules.withColumn("instance_config", engine)
    scored = quality.assess_rules(rules, t.routing_log, NOON)
    return scored.select("rule_model_name", "candidate_model", F.round("score", 6).alias("score"))


@query("udf_route", """
    SELECT t.request_id, CASE r.module_name WHEN 'quality' THEN t.model_name || '-tuned'
           WHEN 'free_tier' THEN CASE WHEN r.priority > 5 THEN 'vip' ELSE 'pool' END END
           AS target_model
    FROM {traffic} t LEFT JOIN {routing_rules} r ON r.model_name = t.model_name AND r.enabled""")
def udf_route(t):
    registry = routing.RouteRegistry()
    registry.register("quality", lambda df: F.concat(df["model_name"], F.lit("-tuned")))
    registry.register("free_tier", lambda df: F.when(df["priority"] > 5, "vip").otherwise("pool"))
    registry.register("prompt_length", lambda df: df["no_such_column"])
    return registry.route(routing.match_rule(t.traffic, t.routing_rules)).select(
        "request_id", "target_model")


@query("stage_pipeline", """
    SELECT request_id, turn, UPPER(role) AS role, LENGTH(body) AS size,
           CASE WHEN LENGTH(body) > 200 THEN 'rejected by f_limit'
                WHEN turn % 3 = 2 THEN 'error in g_ratio' ELSE 'passed' END AS disposition
    FROM {messages} WHERE role <> 'system'""")
def stage_pipeline(t):
    """Failing stages are skipped, one rejects rows, one fails for single rows; a deliberate block
    of the whole frame ends the chain."""
    def broken(df):
        return df.select("no_such_column")

    def block(df):
        raise stages.BlockRequest("not today")

    steps = {"a_drop_system": lambda df: df.filter("role <> 'system'"),
             "b_broken": broken, "c_unchanged": lambda df: None,
             "d_disabled": lambda df: df.limit(0),
             "e_upper": lambda df: df.withColumn("role", F.upper("role")),
             "f_limit": stages.rejecting("f_limit", lambda df: F.col("size") > 200),
             "g_ratio": stages.guarded("g_ratio", lambda df: F.try_divide(
                 F.col("size"), F.when(F.col("turn") % 3 != 2, F.lit(1))))}
    rows = t.messages.select("request_id", "turn", "role",
                             F.length("body").cast("bigint").alias("size"))
    registry = [("d_disabled", False), ("a_drop_system", True)]
    try:
        return stages.pipeline(rows, steps | {"b_block": block}, registry).limit(0)
    except stages.BlockRequest:
        return stages.pipeline(rows, steps, registry)


@query("merge_headers", """
    SELECT request_id, STRING_AGG(name || '=' || value, ';' ORDER BY name) AS headers
    FROM (SELECT o_custkey AS request_id, 'x-' || o_orderpriority AS name,
                 MAX_BY(o_orderstatus || o_orderkey, o_orderkey) AS value
          FROM {orders} GROUP BY 1, 2) h GROUP BY request_id""")
def merge_headers(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("request_id"),
        F.concat(F.lit("x-"), "o_orderpriority").alias("name"),
        F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("value"),
        F.col("o_orderkey").alias("stage"))
    merged = stages.merge_maps(rows, ["request_id"], "name", "value", "stage")
    entries = F.transform(F.map_entries("headers"),
                          lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("request_id", F.array_join(entries, ";").alias("headers"))
