"""Groups that have no rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_all(counted: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``groups``, with its row of ``counted`` or nulls; null is a group like any other."""
    others = [c for c in counted.columns if c not in keys]
    found = counted.select(*(F.col(k).alias(f"_{k}") for k in keys), *others)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return groups.select(*keys).distinct().join(found, same, "left").select(*keys, *others)
