"""Queries over state tables: upserts, deletes, registry, cooldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.functions import clock
from relaylens.operators import cooldown, quality, state
from relaylens.plans import frames
from relaylens.plans.registry import query
from relaylens.session import scratch_path
from relaylens.sources import schemas
from relaylens.sources.keyed_table import KeyedTable

EVENING = "2024-01-29 20:00:00"
RULE_COLUMNS = "model_name, module_name, enabled, priority, instance_config"
RULE_FULL = dict.fromkeys(["module_name", "enabled", "priority", "instance_config"],
                          state.OVERWRITE)
_LAST_EDIT = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY model_name ORDER BY edit_id DESC) AS rn FROM {rule_edits}) q WHERE rn = 1)"""


@query("upsert_overwrite", f"""
    SELECT {RULE_COLUMNS} FROM {_LAST_EDIT} e
    UNION ALL SELECT {RULE_COLUMNS} FROM {{routing_rules}} r
    WHERE NOT EXISTS (SELECT 1 FROM {{rule_edits}} e WHERE e.model_name = r.model_name)""")
def upsert_overwrite(t):
    return state.keyed_upsert(t.routing_rules, t.rule_edits, ["model_name"], RULE_FULL,
                              ["edit_id"])


@query("upsert_deltas", f"""
    SELECT {RULE_COLUMNS} FROM {_LAST_EDIT} e
    UNION ALL SELECT {RULE_COLUMNS} FROM {{routing_rules}} r
    WHERE NOT EXISTS (SELECT 1 FROM {{rule_edits}} e WHERE e.model_name = r.model_name)""")
def upsert_deltas(t):
    """The rules, then their edits in three batches by id; compacted before the last one."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "rules"), schemas.ROUTING_RULES,
                       ["model_name"], RULE_FULL, ["edit_id"])
    table.merge(t.routing_rules.withColumn("edit_id", F.lit(0)))
    bounds = t.rule_edits.agg(F.min("edit_id").alias("a"), F.max("edit_id").alias("b")).first()
    first, width = bounds["a"] or 0, ((bounds["b"] or 0) - (bounds["a"] or 0)) // 3 + 1
    for k in range(3):
        if k == 2:
            table.compact()
        table.merge(t.rule_edits.filter(F.floor((F.col("edit_id") - first) / width) == k))
    return table.read()


@query("upsert_partial", f"""
    SELECT model_name, COALESCE(e.module_name, r.module_name) AS module_name,
           COALESCE(r.enabled, true) AS enabled,
           COALESCE(e.priority, r.priority) AS priority, r.instance_config
    FROM {{routing_rules}} r FULL OUTER JOIN {_LAST_EDIT} e USING (model_name)""")
def upsert_partial(t):
    policies = {"module_name": state.OVERWRITE, "enabled": state.KEEP,
                "priority": state.OVERWRITE, "instance_config": state.KEEP}
    edits = t.rule_edits.select("model_name", "edit_id", "module_name", "priority").withColumns(
        {"enabled": F.lit(True), "instance_config": F.lit(None).cast("string")})
    return state.keyed_upsert(t.routing_rules, edits, ["model_name"], policies, ["edit_id"],
                              small_updates=True)


@query("upsert_increment", """
    SELECT rule_model_name, candidate_model,
           ROUND(COALESCE(u.score, w.score), 6) AS score,
           COALESCE(u.ts, w.last_assessed_at) AS last_assessed_at,
           COALESCE(w.assessment_count, 0) + COALESCE(u.n, 0) AS assessment_count
    FROM {early_weights} w FULL OUTER JOIN (
      SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY rule_model_name, candidate_model) AS n,
               ROW_NUMBER() OVER (PARTITION BY rule_model_name, candidate_model
                                  ORDER BY ts DESC, event_id DESC) AS rn
             FROM {assessments}) q WHERE rn = 1) u USING (rule_model_name, candidate_model)""")
def upsert_increment(t):
    scores = t.assessments.withColumnRenamed("ts", "last_assessed_at")
    merged = quality.update_weights(t.early_weights, scores, ["last_assessed_at", "event_id"])
    return merged.withColumn("score", F.round("score", 6))


@query("delete_keys", """
    SELECT model_name, 'kept' AS outcome FROM {routing_rules}
    WHERE model_name NOT IN (SELECT model_name FROM {rule_edits} WHERE module_name = 'quality')
    UNION ALL
    SELECT DISTINCT model_name, 'missing' FROM {rule_edits}
    WHERE module_name = 'quality'
      AND model_name NOT IN (SELECT model_name FROM {routing_rules})""")
def delete_keys(t):
    doomed = t.rule_edits.filter("module_name = 'quality'")
    kept, missing = state.delete_by_keys(t.routing_rules, doomed, ["model_name"])
    return (kept.select("model_name", F.lit("kept").alias("outcome"))
            .union(missing.select("model_name", F.lit("missing"))))


@query("set_enabled", """
    SELECT model_name, CASE WHEN model_name IN (SELECT model_name FROM {rule_edits}
           WHERE module_name = 'free_tier') THEN false ELSE enabled END AS enabled, true AS known
    FROM {routing_rules}
    UNION ALL
    SELECT DISTINCT model_name, CAST(NULL AS BOOLEAN), false FROM {rule_edits}
    WHERE module_name = 'free_tier' AND model_name NOT IN (SELECT model_name FROM {routing_rules})""")
def set_enabled(t):
    wanted = t.rule_edits.filter("module_name = 'free_tier'")
    toggled, unknown = state.set_enabled(t.routing_rules, wanted, ["model_name"], False)
    return (toggled.select("model_name", "enabled", F.lit(True).alias("known"))
            .union(unknown.select("model_name", F.lit(None).cast("boolean"), F.lit(False))))


@query("lookup_rule", f"""
    SELECT {RULE_COLUMNS} FROM {{routing_rules}} WHERE model_name = 'model-42'""")
def lookup_rule(t):
    rules = frames.written(t, t.routing_rules, "rules")  # a stored column, so the filter is pushed
    return state.lookup(rules, model_name="model-42")


@query("rule_counts", """
    SELECT module_name, COUNT(*) AS rule_count FROM {routing_rules} GROUP BY module_name""")
def rule_counts(t):
    return state.rule_counts(t.routing_rules)


@query("rules_health", """
    SELECT COUNT(*) AS routing_rules_count,
           COUNT(DISTINCT CASE WHEN known THEN module_name END) AS valid_modules,
           COUNT(DISTINCT CASE WHEN NOT known THEN module_name END) AS invalid_modules,
           COUNT(*) FILTER (NOT known) AS invalid_rules,
           CASE WHEN COUNT(*) FILTER (NOT known) > 0 THEN 'unhealthy' ELSE 'healthy' END AS status
    FROM (SELECT module_name, module_name IN (SELECT module_name FROM {routing_modules}) AS known
          FROM {routing_rules}) r""")
def rules_health(t):
    return state.rules_health(t.routing_rules, t.routing_modules)


@query("modules_list", """
    SELECT module_name, COALESCE(display_name, module_name) AS display_name,
           COALESCE(description, '') AS description, COALESCE(version, '1.0.0') AS version, enabled
    FROM {routing_modules} WHERE enabled""")
def modules_list(t):
    return state.list_modules(t.routing_modules, enabled_only=True, by_display_name=True)


@query("cooldown_next_reset", """
    SELECT event_id,
           CASE WHEN ts < CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
                THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
                ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR END AS reset_utc,
           CASE WHEN ts < CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 11 HOUR
                THEN CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 11 HOUR
                ELSE CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 35 HOUR
                END AS reset_new_york
    FROM {events}""")
def cooldown_next_reset(t):
    return t.events.select(
        "event_id", clock.next_reset(F.col("ts"), 6).alias("reset_utc"),
        clock.next_reset(F.col("ts"), 6, "America/New_York").alias("reset_new_york"))


_SET = """
    SELECT model_key, MAX(CASE WHEN EXTRACT(HOUR FROM ts) < 6
             THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
             ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR END) AS cooldown_until
    FROM {rate_limit_events} GROUP BY model_key"""


def _cooldowns(t):
    return cooldown.from_errors(t.rate_limit_events, hour=6)


@query("cooldown_set", _SET)
def cooldown_set(t):
    return _cooldowns(t)


@query("cooldown_status", f"""
    SELECT model_key, cooldown_until, CAST(NULL AS BIGINT) AS active_count,
           CAST(NULL AS BIGINT) AS total_cooldown_records
    FROM ({_SET}) c WHERE cooldown_until > {{at}}'2024-01-29 20:00:00'
    UNION ALL
    SELECT NULL, NULL, COUNT(*) FILTER (cooldown_until > {{at}}'2024-01-29 20:00:00'), COUNT(*)
    FROM ({_SET}) c""")
def cooldown_status(t):
    active, counts = cooldown.status(_cooldowns(t), EVENING)
    return active.unionByName(counts, allowMissingColumns=True)


@query("cooldown_list", f"""
    SELECT model_key, cooldown_until, cooldown_until > {{at}}'2024-01-29 20:00:00' AS is_active
    FROM ({_SET}) c""")
def cooldown_list(t):
    return cooldown.listing(_cooldowns(t), EVENING)


@query("cooldown_clear", f"""
    SELECT 'expired' AS cleared, model_key FROM ({_SET}) c
    WHERE cooldown_until > {{at}}'2024-01-29 20:00:00'
    UNION ALL SELECT 'active', model_key FROM ({_SET}) c
    WHERE cooldown_until <= {{at}}'2024-01-29 20:00:00'
    UNION ALL SELECT 'key', model_key FROM ({_SET}) c WHERE model_key <> 'model-8-free'""")
def cooldown_clear(t):
    table = _cooldowns(t)
    runs = [("expired", cooldown.clear(table, EVENING)),
            ("active", cooldown.clear(table, EVENING, "active")),
            ("key", cooldown.clear(table, mode="key", key="model-8-free"))]
    left = [df.select(F.lit(name).alias("cleared"), "model_key") for name, df in runs]
    return left[0].union(left[1]).union(left[2])
