"""Mapping of raw upload columns to canonical fields, for any number of uploads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.functions.bands import confidence_tier

# Mapping targets, the fields that must be mapped, and the pre-mapped threshold.
TARGETS = (
    "NPI", "First Name", "Last Name", "Specialty", "State", "Email", "Phone", "ZIP Code",
    "DEA Number", "Address", "City", "Country", "Notes", "Ignore",
)
REQUIRED = ("NPI", "First Name", "Last Name")
PRE_MAPPED = 0.80


def resolve(suggestions: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Final target per raw column: the user's choice if there is one, else the suggestion.

    ``overrides`` holds at most one ``(keys, raw, target)`` row per column; dropping the row resets the
    column to its suggestion.
    """
    chosen = overrides.select(*keys, "raw", F.col("target").alias("chosen"))
    return (
        suggestions.join(chosen, [*keys, "raw"], "left")
        .withColumn("target", F.coalesce("chosen", "suggested"))
        .withColumn("overridden", F.col("target") != F.col("suggested"))
        .withColumn("tier", confidence_tier(F.col("confidence")))
        .drop("chosen")
    )


def report(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Per upload: missing required fields, doubly used fields, counters and whether it may proceed."""
    used = {t: F.count_if(F.col("target") == t) for t in TARGETS if t != "Ignore"}
    counted = resolved.groupBy(*keys).agg(
        F.count_if(F.col("confidence") >= PRE_MAPPED).alias("pre_mapped"),
        F.count_if("overridden").alias("overridden"),
        F.count(F.lit(1)).alias("columns"),
        F.array(*[F.struct(F.lit(t).alias("target"), n.alias("n")) for t, n in used.items()]).alias("used"),
    )

    def names(condition):
        return F.transform(F.filter("used", condition), lambda u: u["target"])

    missing = names(lambda u: (u["n"] == 0) & u["target"].isin(*REQUIRED))
    doubled = names(lambda u: u["n"] > 1)
    return counted.select(
        *keys,
        "columns",
        "pre_mapped",
        "overridden",
        missing.alias("missing_required"),
        doubled.alias("duplicated"),
        ((F.size(missing) == 0) & (F.size(doubled) == 0)).alias("can_proceed"),
    )


def missing_required(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, target)`` for every required field an upload does not map."""
    per_upload = resolved.groupBy(*keys).agg(F.collect_set("target").alias("targets"))
    required = F.array(*[F.lit(r) for r in REQUIRED])
    return per_upload.select(*keys, F.explode(F.array_except(required, "targets")).alias("target"))


def apply(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename raw columns to their targets and drop those mapped to ``Ignore``."""
    return df.select(*[F.col(f"`{raw}`").alias(to) for raw, to in mapping.items() if to != "Ignore"])
