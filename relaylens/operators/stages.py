"""User stages over a request frame, and merging of the values they add."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

logger = logging.getLogger(__name__)


class BlockRequest(Exception):
    """Raised by a stage that rejects the whole frame on purpose."""


def pipeline(df: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame | None]],
             registry: Iterable[tuple[str, bool]] = ()) -> DataFrame:
    """Apply the enabled stages in name order.

    A stage returns a new frame, or None to leave it unchanged. Stages the registry does not
    list count as enabled. A stage that fails while the plan is built is skipped, except for a
    deliberate block. ``registry`` is the short list of stages, not a table.
    """
    enabled = dict(registry)
    for name in sorted(stages):
        if not enabled.get(name, True):
            continue
        try:
            result = stages[name](df)
            if result is not None:
                result.schema  # unresolved columns surface here, not in the next stage
                df = result
        except BlockRequest:
            raise
        except Exception as error:
            logger.error("stage %s failed: %s", name, error)
    return df


def _disposed(df: DataFrame, found: Column) -> DataFrame:
    """The first disposition of a row stays; rows without one have passed."""
    known = F.col("disposition") if "disposition" in df.columns else F.lit("passed")
    return df.withColumn("disposition", F.when(known == "passed", F.coalesce(
        found, F.lit("passed"))).otherwise(known))


def rejecting(name: str, test: Callable[[DataFrame], Column]) -> Callable[[DataFrame], DataFrame]:
    """A stage that marks the rows it rejects in ``disposition`` and keeps them in the frame."""
    return lambda df: _disposed(df, F.when(test(df), F.lit(f"rejected by {name}")))


def guarded(name: str, value: Callable[[DataFrame], Column]) -> Callable[[DataFrame], DataFrame]:
    """A stage whose expression is null where it fails (the ``try_`` functions): such rows are
    marked in ``disposition``, and the job goes on."""
    return lambda df: _disposed(df, F.when(value(df).isNull(), F.lit(f"error in {name}")))


def merge_maps(rows: DataFrame, keys: list[str], name: str, value: str, order: str,
               into: str = "headers") -> DataFrame:
    """One map per group; of several values of one name the last in ``order`` wins.

    The values collapse by a mergeable aggregate first, so a map has one entry per name.
    """
    last = rows.groupBy(*keys, name).agg(F.max_by(value, order).alias(value))
    entries = F.array_sort(F.collect_list(F.struct(name, value)))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias(into))


def merge_map_columns(*maps: Column) -> Column:
    """The same merge for maps that are columns of one row; null when all are empty."""
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast(
        "ARRAY<STRUCT<key: STRING, value: STRING>>")) for m in maps]))
    empty = F.create_map().cast("MAP<STRING,STRING>")
    merged = F.aggregate(entries, empty, lambda acc, e: F.map_concat(
        F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(F.size(entries) > 0, merged)
