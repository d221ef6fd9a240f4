"""Severities, labels and rounding rules shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "High", 3).when(severity == "Medium", 2).otherwise(1)


def half_up(value: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(value + F.lit(0.5)).cast("long")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "High").when(confidence >= 0.75, "Medium").otherwise("Low")


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 85, "Excellent").when(score >= 65, "Good").when(score >= 45, "Fair").otherwise("Poor")
    )


def null_band(pct: Column) -> Column:
    return F.when(pct == 0, "success").when(pct <= 5, "warning").otherwise("danger")


def field_health_band(pct: Column) -> Column:
    return F.when(pct >= 90, "success").when(pct >= 70, "warning").otherwise("danger")


def upload_band(pct: Column) -> Column:
    return F.when(pct >= 80, "success").when(pct >= 65, "warning").otherwise("danger")


def anomaly_band(score: Column) -> Column:
    return F.when(score >= 0.85, "High").when(score >= 0.70, "Medium").otherwise("Low")


def similarity_band(score: Column) -> Column:
    return F.when(score >= 95, "danger").when(score >= 85, "warning").otherwise("info")
