"""Typing, merging and checking of module configuration."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The texts that count as true.
TRUE_WORDS = ("true", "1", "yes", "on")
TEXT_MAP = "MAP<STRING,STRING>"


def parse(json_text: Column) -> Column:
    """A JSON object as a map of texts; null or unreadable text gives an empty map."""
    empty = F.create_map().cast(TEXT_MAP)
    return F.coalesce(F.from_json(json_text, TEXT_MAP), empty)


def effective(general: Column, instance: Column) -> Column:
    """Both maps merged; an instance key wins, even when its value is null."""
    empty = F.create_map().cast(TEXT_MAP)
    general, instance = F.coalesce(general, empty), F.coalesce(instance, empty)
    inherited = F.map_filter(general, lambda key, _: ~F.map_contains_key(instance, key))
    return F.map_concat(inherited, instance)


def as_boolean(raw: Column) -> Column:
    return F.lower(raw).isin(*TRUE_WORDS)


def coerce(raw: Column, kind: Column) -> Column:
    """A text by its declared type: one field per type, and ``text`` if nothing else fits."""
    boolean = F.when(kind == "boolean", as_boolean(raw))
    integer = F.when(kind == "integer", raw.try_cast("bigint"))
    number = F.when(kind == "number", raw.try_cast("double"))
    json = F.when(kind.isin("array", "object"), F.to_json(F.try_parse_json(raw)))
    typed = F.coalesce(boolean.cast("string"), integer.cast("string"),
                       number.cast("string"), json)
    return F.struct(boolean.alias("boolean"), integer.alias("integer"), number.alias("number"),
                    json.alias("json"), F.when(typed.isNull(), raw).alias("text"))


def is_valid(value: Column, kind: Column, choices: Column, low: Column, high: Column) -> Column:
    """Whether a value has the declared type, is one of the choices and lies in the range."""
    typed = coerce(value, kind)
    shaped = (F.when(kind == "integer", typed["integer"].isNotNull())
              .when(kind == "number", typed["number"].isNotNull())
              .when(kind.isin("array", "object"), typed["json"].isNotNull())
              .otherwise(F.lit(True)))
    listed = choices.isNull() | F.array_contains(choices, value)
    size = F.coalesce(typed["number"], typed["integer"].cast("double"))
    ranged = (F.coalesce(size >= low, F.lit(True)) & F.coalesce(size <= high, F.lit(True)))
    return F.coalesce(shaped & listed & ranged, F.lit(False))
