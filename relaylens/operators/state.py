"""Maintenance of keyed state tables: upsert, delete, toggle, look up, check references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaylens.functions import clock

OVERWRITE, KEEP, GREATEST, INCREMENT = "overwrite", "keep", "greatest", "increment"
AGREE = "agree"


def collapse(updates: DataFrame, keys: list[str], policies: dict[str, str],
             order: list[str]) -> DataFrame:
    """One row per key with the effect of applying its updates in ``order``.

    Everything here is a mergeable aggregate, so a key that owns a third of the updates is
    reduced before the shuffle.
    """
    at = F.struct(*order)
    merged = {OVERWRITE: lambda c: F.max_by(c, at), KEEP: lambda c: F.min_by(c, at),
              GREATEST: F.max, INCREMENT: lambda c: F.count(F.lit(1)),
              AGREE: lambda c: F.when(F.min(c) == F.max(c), F.min(c))}
    return updates.groupBy(*keys).agg(
        *[merged[policy](F.col(c) if c in updates.columns else None).alias(c)
          for c, policy in policies.items()])


def keyed_upsert(target: DataFrame, updates: DataFrame, keys: list[str],
                 policies: dict[str, str], order: list[str],
                 small_updates: bool = False) -> DataFrame:
    """The state after inserting new keys and merging known ones column by column.

    ``overwrite`` takes the last update, ``keep`` the stored value (else the first update),
    ``greatest`` the larger one, ``increment`` adds the number of updates; ``agree`` keeps a value
    that all updates share and is null, for good, once two differ.

    The default is one full outer join; a target bucketed by its keys is not shuffled for it.
    ``small_updates`` merges by a left join and appends the unknown keys, which lets Spark
    broadcast the updates when they are below its threshold and leaves the target unshuffled.
    """
    delta = collapse(updates, keys, policies, order)
    stored = target.select(*keys, F.lit(True).alias("_stored"),
                           *[F.col(c).alias(f"_old_{c}") for c in policies])

    def value(column: str, policy: str) -> Column:
        old, new, known = F.col(f"_old_{column}"), F.col(column), F.col("_stored")
        touched = F.col("_touched")
        changed = {OVERWRITE: new, KEEP: F.when(known, old).otherwise(new),
                   GREATEST: F.greatest(old, new),
                   AGREE: F.when(~F.coalesce(known, F.lit(False)) | (old == new), new),
                   INCREMENT: F.coalesce(old, F.lit(0)) + new}[policy]
        return F.when(touched, changed).otherwise(old).alias(column)

    delta = delta.withColumn("_touched", F.lit(True))
    merged_columns = [value(c, p) for c, p in policies.items()]
    if not small_updates:
        return stored.join(delta, keys, "full_outer").select(*keys, *merged_columns)
    # Both uses of the collapsed updates share one exchange.
    inserted = delta.join(target.select(*keys), keys, "left_anti")
    merged = stored.join(delta, keys, "left").select(*keys, *merged_columns)
    return merged.unionByName(inserted.select(*keys, *policies))


def delete_by_keys(target: DataFrame, doomed: DataFrame,
                   keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the requested keys that were not there."""
    wanted = doomed.select(*keys).distinct()
    return target.join(wanted, keys, "left_anti"), wanted.join(target, keys, "left_anti")


def set_enabled(target: DataFrame, wanted: DataFrame, keys: list[str],
                flag: bool) -> tuple[DataFrame, DataFrame]:
    """Toggle the listed keys; the second frame lists the unknown ones."""
    listed = wanted.select(*keys).distinct()
    toggled = target.join(listed.withColumn("_listed", F.lit(True)), keys, "left").withColumn(
        "enabled", F.when(F.col("_listed"), F.lit(flag)).otherwise(F.col("enabled")))
    return toggled.drop("_listed"), listed.join(target, keys, "left_anti")


def lookup(target: DataFrame, **key) -> DataFrame:
    """The row of one key; an equality filter that the scan can push down."""
    for name, value in key.items():
        target = target.filter(F.col(name) == F.lit(value))
    return target


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("module_name").agg(F.count(F.lit(1)).alias("rule_count"))


def invalid_rules(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Rules that name an unregistered module."""
    return rules.join(registry.select("module_name"), "module_name", "left_anti")


def rules_health(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """One status row: how many rules there are and how many point nowhere."""
    known = registry.select("module_name", F.lit(True).alias("_known"))
    checked = rule_counts(rules).join(known, "module_name", "left")
    unknown = F.col("_known").isNull()
    counts = checked.agg(
        F.coalesce(F.sum("rule_count"), F.lit(0)).alias("routing_rules_count"),
        F.count_if(~unknown).alias("valid_modules"),
        F.count_if(unknown).alias("invalid_modules"),
        F.coalesce(F.sum(F.when(unknown, F.col("rule_count"))), F.lit(0)).alias("invalid_rules"))
    return counts.withColumn("status", F.when(F.col("invalid_rules") > 0, "unhealthy")
                             .otherwise("healthy"))


def list_modules(registry: DataFrame, enabled_only: bool = False,
                 by_display_name: bool = False) -> DataFrame:
    """Registry listing with fallbacks for missing (null or empty) texts."""
    def filled(column, fallback):
        text = F.col(column)
        return F.when(text.isNull() | (text == ""), fallback).otherwise(text).alias(column)

    rows = registry.filter("enabled") if enabled_only else registry
    # the fallbacks apply after ordering by the stored value
    ordered = rows.orderBy("display_name" if by_display_name else "module_name", "module_name")
    return ordered.select("module_name", filled("display_name", F.col("module_name")),
                          filled("description", F.lit("")), filled("version", F.lit("1.0.0")),
                          "enabled")


def module_overview(registry: DataFrame, rules: DataFrame, breakers: DataFrame,
                    tokens: DataFrame, as_of, token_module: str = "pii_tokens") -> DataFrame:
    """Modules with rule count, breaker state and, for the masking module, token counts."""
    live = tokens.agg(F.count_if(F.col("expires_at") > clock.instant(as_of)).alias("active_tokens"),
                      F.count(F.lit(1)).alias("total_tokens"))
    stats = live.withColumn("module_name", F.lit(token_module))
    return (list_modules(registry)
            .join(rule_counts(rules), "module_name", "left")
            .join(breakers.select("module_name", F.col("state").alias("cb_state")),
                  "module_name", "left")
            .join(stats, "module_name", "left")
            .withColumn("rule_count", F.coalesce("rule_count", F.lit(0)))
            .withColumn("cb_state", F.coalesce("cb_state", F.lit("closed"))))
