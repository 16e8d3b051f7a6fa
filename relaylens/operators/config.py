"""Configuration rows as maps and as checked, complete settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.functions import config as settings

SCHEMA_COLUMNS = ("kind STRING, config_key STRING, type STRING, default_value STRING, "
                  "choices ARRAY<STRING>, minimum DOUBLE, maximum DOUBLE")

# The declared settings of the three bundled strategies and the two text guards.
SCHEMA_ROWS = [
    ("free_tier", "cooldown_reset_hour", "integer", "0", None, 0.0, 23.0),
    ("free_tier", "cooldown_timezone", "string", "UTC", None, None, None),
    ("free_tier", "fallback_enabled", "boolean", "true", None, None, None),
    ("prompt_length", "threshold", "integer", "1000", None, None, None),
    ("prompt_length", "model_under", "string", None, None, None, None),
    ("prompt_length", "model_over", "string", None, None, None, None),
    ("quality", "models", "array", "[]", None, None, None),
    ("quality", "judge_engine", "string", "response_metrics",
     ["response_metrics", "self_consistency", "llm_judge", "reward_model", "hybrid"], None, None),
    ("quality", "scoring_metric", "string", "quality_cost_ratio",
     ["quality", "quality_cost_ratio", "latency_quality_ratio"], None, None),
    ("quality", "assessment_interval_minutes", "integer", "60", None, None, None),
    ("quality", "selection_strategy", "string", "weighted_random",
     ["weighted_random", "top_k", "epsilon_greedy"], None, None),
    ("quality", "cold_start_strategy", "string", "cost_weighted",
     ["round_robin", "cost_weighted"], None, None),
    ("quality", "epsilon", "number", "0.1", None, None, None),
    ("quality", "top_k", "integer", "1", None, None, None),
    ("pii", "token_ttl_hours", "integer", "24", None, None, None),
    ("pii", "enabled", "boolean", "true", None, None, None),
    ("injection", "action", "string", "log_only", ["log_only", "flag", "block"], None, None),
    ("injection", "scan_roles", "string", "user", None, None, None),
    ("injection", "custom_patterns", "string", "", None, None, None),
]


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA_ROWS, SCHEMA_COLUMNS)


def config_map(rows: DataFrame) -> DataFrame:
    """One map per module. Duplicated pairs collapse first, so a map has one entry per key."""
    unique = rows.groupBy("module_name", "config_key").agg(
        F.max("config_value").alias("config_value"))
    return unique.groupBy("module_name").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("config_key", "config_value")))).alias("config"))


def config_wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The named settings as columns, by one mergeable aggregate and without building maps."""
    return rows.groupBy("module_name").agg(*[
        F.max(F.when(F.col("config_key") == key, F.col("config_value"))).alias(key)
        for key in keys])


def coerce_rows(rows: DataFrame, schema: DataFrame, modules: DataFrame) -> DataFrame:
    """Typed values by the schema of each row's module; keys it does not declare stay texts.

    ``modules`` names the schema of each module in ``kind``. A module declares a key once, so the
    joins never multiply rows, however other modules type the same key.
    """
    kinds = modules.select("module_name", "kind").dropDuplicates(["module_name"])
    types = schema.groupBy("kind", "config_key").agg(F.max("type").alias("type"))
    typed = settings.coerce(F.col("config_value"), F.coalesce("type", F.lit("string")))
    return (rows.join(kinds, "module_name", "left").join(types, ["kind", "config_key"], "left")
            .withColumn("typed", typed)
            .select("module_name", "config_key", "config_value",
                    F.col("typed.boolean").alias("boolean_value"),
                    F.col("typed.integer").alias("integer_value"),
                    F.col("typed.number").alias("number_value"),
                    F.col("typed.json").alias("json_value"),
                    F.col("typed.text").alias("text_value")))


def with_defaults(modules: DataFrame, rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Every declared setting of every module: the stored value or the default, and validity.

    ``modules`` names the schema of each module in ``kind``; both joins are equi-joins.
    """
    declared = modules.select("module_name", "kind").join(schema, "kind")
    value = F.coalesce("config_value", "default_value")
    return (declared.join(rows, ["module_name", "config_key"], "left")
            .select("module_name", "config_key", value.alias("value"),
                    F.col("config_value").isNull().alias("defaulted"),
                    settings.is_valid(value, F.col("type"), F.col("choices"), F.col("minimum"),
                                      F.col("maximum")).alias("valid")))
