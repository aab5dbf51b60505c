"""A lookup of one right row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, of which ``right`` has one row each.

    Frequent and missing keys of the left side are left to the adaptive skew join, which
    splits their partitions at run time.
    """
    return left.join(right, key, "left")
