"""Repeatable pseudo-random numbers: a draw is a hash of the row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of SHA-256."""
    salted = F.concat(key.cast("string"), F.lit(f"|{seed}")) if seed else key.cast("string")
    digits = F.conv(F.substring(F.sha2(salted, 256), 1, 13), 16, 10)
    return digits.cast("double") / F.lit(float(16 ** 13))
