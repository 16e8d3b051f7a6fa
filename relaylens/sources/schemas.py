"""Explicit schemas of the log, state and configuration tables."""

from __future__ import annotations

ROUTING_LOG = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, model_name STRING, module_name STRING, "
    "target_model STRING, response_time_ms DOUBLE, success BOOLEAN, error_message STRING"
)
ROUTING_RULES = (
    "model_name STRING, module_name STRING, enabled BOOLEAN, priority INT, instance_config STRING"
)
MODULE_CONFIGS = "module_name STRING, config_key STRING, config_value STRING"
ROUTING_MODULES = (
    "module_name STRING, display_name STRING, description STRING, version STRING, "
    "enabled BOOLEAN, config_schema STRING"
)
COOLDOWNS = "model_key STRING, cooldown_until TIMESTAMP_NTZ"
BREAKER_CONFIGS = (
    "module_name STRING, failure_threshold INT, recovery_timeout INT, "
    "success_threshold INT, timeout_seconds DOUBLE, enabled BOOLEAN"
)
PII_TOKENS = (
    "token STRING, original_value STRING, entity_type STRING, request_id STRING, "
    "expires_at TIMESTAMP_NTZ"
)
QUALITY_WEIGHTS = (
    "rule_model_name STRING, candidate_model STRING, score DOUBLE, "
    "last_assessed_at TIMESTAMP_NTZ, assessment_count BIGINT"
)
MESSAGE_PARTS = "ARRAY<STRUCT<type: STRING, text: STRING>>"
CHUNKS = "request_id STRING, seq BIGINT, ts TIMESTAMP, delta STRING, finish_reason STRING"
