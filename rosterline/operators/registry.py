"""Check of provider numbers against a registry snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.functions.validators import has_valid_check_digit, normalize
from rosterline.operators.skew import copied

SEVERITY = {"Inactive": "Medium", "Mismatch": "Medium", "Invalid": "High", "Not Found": "High"}


def validate(
    records: DataFrame,
    registry: DataFrame | None,
    precedence: tuple[str, ...] = ("Inactive", "Mismatch", "Invalid", "Not Found"),
) -> DataFrame:
    """Add ``issues`` (all that apply, in order of precedence), ``issue_type`` and ``severity``.

    ``registry`` has one ``(npi, status, specialty, deactivated_year)`` row per number. Without a
    snapshot every record is ``pending``.
    """
    if registry is None:
        return records.select(
            "*",
            F.lit(None).cast("array<string>").alias("issues"),
            F.lit("pending").alias("issue_type"),
            F.lit(None).cast("string").alias("severity"),
        )
    # one row per number, whatever the snapshot holds: the first by its fields, and numbers are compared as the records' are
    known = registry.withColumn("_npi", normalize(F.col("npi"))).groupBy("_npi").agg(
        F.min(F.struct("status", "specialty", "deactivated_year")).alias("r")
    ).select("_npi", "r.*")
    known = known.select(
        copied(F.col("_npi")).alias("_known"),
        F.col("status").alias("registry_status"),
        F.col("specialty").alias("registry_specialty"),
        "deactivated_year",
    )
    named = records.withColumn("_npi", normalize(F.col("npi")))
    joined = named.join(known, F.col("_npi") == F.col("_known"), "left").drop("_known")
    found = F.col("registry_status").isNotNull()
    tests = {
        "Inactive": found & (F.col("registry_status") != "Active"),
        "Mismatch": found & (F.lower("registry_specialty") != F.lower("specialty")),
        "Invalid": ~has_valid_check_digit(F.col("_npi")),
        "Not Found": ~found,
    }
    issues = F.array_compact(F.array(*[F.when(tests[i], F.lit(i)) for i in precedence]))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return (
        joined.withColumn("issues", issues)
        .withColumn("issue_type", F.try_element_at("issues", F.lit(1)))
        .withColumn("severity", severity[F.col("issue_type")])
        .drop("_npi")
    )


def errors(validated: DataFrame) -> DataFrame:
    return validated.where("issue_type IS NOT NULL AND issue_type <> 'pending'")
