"""The 0-100 data health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.bands import half_up, score_label, severity_rank

# Most points per category, and the flag density penalty.
WEIGHTS = {"npi_validation": 30, "pii": 25, "duplicates": 25, "outliers": 20}
UNWEIGHTED = "duplicates"
PENALTY_PER_DENSITY = 0.4
MAX_PENALTY = 5


def sums_of(flags: DataFrame, by: list[str]) -> DataFrame:
    """Per group: for every category the number of flags and the total and resolved weights. These add up over parts."""
    category = F.lower("category")
    weight = F.when(category == UNWEIGHTED, 1).otherwise(severity_rank(F.col("severity")))
    weighted = flags.select(*by, category.alias("c"), weight.alias("w"), F.col("resolved").alias("r"))
    sums: list[Column] = []
    for name in WEIGHTS:
        mine = F.col("c") == name
        sums += [
            F.count_if(mine).alias(f"{name}_n"),
            F.coalesce(F.sum(F.when(mine, F.col("w"))), F.lit(0)).alias(f"{name}_total"),
            F.coalesce(F.sum(F.when(mine & F.col("r"), F.col("w"))), F.lit(0)).alias(f"{name}_earned"),
        ]
    return weighted.groupBy(*by).agg(*sums)


def _points(name: str) -> Column:
    """Severity-weighted resolved share times the category's weight; full weight without flags."""
    share = F.try_divide(F.col(f"{name}_earned"), F.col(f"{name}_total"))
    return F.coalesce(share, F.lit(1.0)) * WEIGHTS[name]


def category_points(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group and category, also for categories without flags."""
    by = by or []
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.col(f"{name}_n").alias("flags"),
                _points(name).alias("points"),
                F.lit(float(WEIGHTS[name])).alias("max_points"),
            )
            for name in WEIGHTS
        ]
    )
    return sums_of(flags, by).select(*by, F.inline(rows))


def health_score(flags: DataFrame, sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score and label per group; ``sizes`` has one row per group with ``total_rows``.

    Groups without any flag get full points. Without ``by`` both sides are a single row.
    """
    by = by or []
    sums = sums_of(flags, by)
    if by:
        joined = sizes.join(sums, by, "left")
    else:
        joined = sums.withColumn("total_rows", sizes.select("total_rows").scalar())
    return from_sums(joined, by)


def from_sums(joined: DataFrame, by: list[str]) -> DataFrame:
    """Score and label of groups whose :func:`sums_of` and ``total_rows`` are known; no flag is read again."""
    flag_count = sum((F.coalesce(F.col(f"{n}_n"), F.lit(0)) for n in WEIGHTS), F.lit(0))
    density = F.coalesce(F.try_divide(flag_count, F.col("total_rows") / 1000), F.lit(0.0))
    penalty = F.least(F.lit(float(MAX_PENALTY)), density * PENALTY_PER_DENSITY)
    raw = sum((_points(n) for n in WEIGHTS), F.lit(0.0)) - penalty
    score = F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw))).cast("long")
    return joined.select(*by, flag_count.alias("flags"), score.alias("score")).withColumn(
        "label", score_label(F.col("score"))
    )
