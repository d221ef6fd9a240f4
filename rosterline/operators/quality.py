"""Cell states, field and record health, and the heatmap filter."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions import validators as v
from rosterline.functions.bands import field_health_band, half_up, null_band

STATES = ("complete", "partial", "invalid", "missing")


@dataclass(frozen=True)
class FieldRule:
    """How a cell of one field is judged; ``full`` is the length below which it is only partial.

    One rule per column.
    """

    field: str
    column: str
    valid: Callable[[Column], Column] | None = None
    full: int = 1
    required: bool = False


# The names of the judged fields.
FIELD_RULES = (
    FieldRule("NPI", "npi", v.is_npi, required=True),
    FieldRule("First Name", "first_name", v.is_name, 3, required=True),
    FieldRule("Last Name", "last_name", v.is_name, 3, required=True),
    FieldRule("Specialty", "specialty", v.is_specialty, 4),
    FieldRule("State", "state", v.is_state),
    FieldRule("Email", "email", v.is_email),
    FieldRule("Phone", "phone", v.is_phone),
    FieldRule("ZIP Code", "zip", lambda x: x.rlike("^[0-9]{3,5}(-[0-9]{4})?$"), 5),
    FieldRule("DEA #", "dea", lambda x: x.rlike("^[A-Z]{2}[0-9]{7}$")),
    FieldRule("Address", "address", None, 10),
)


def null_pct(columns: list[str]) -> Column:
    """Percentage of a row's named columns that are blank."""
    blank = sum((v.is_blank(F.col(c)).cast("int") for c in columns), F.lit(0))
    return blank * 100.0 / len(columns)


def _normalized(df: DataFrame, rules: tuple[FieldRule, ...]) -> DataFrame:
    """Add the normalised value of every judged column once, for all conditions on it."""
    return df.withColumns({f"_{r.column}": v.normalize(F.col(r.column)) for r in rules})


def _status(rule: FieldRule) -> Column:
    """missing, then invalid, then partial, else complete; reads the normalised value."""
    value = F.col(f"_{rule.column}")
    status = F.when(value == "", "missing")
    if rule.valid is not None:
        status = status.when(~rule.valid(value), "invalid")
    return status.when(F.char_length(value) < rule.full, "partial").otherwise("complete")


def _shown(rules: tuple[FieldRule, ...], fields: list[str] | None) -> list[FieldRule]:
    return [r for r in rules if fields is None or r.field in fields]


def cells(
    df: DataFrame,
    rules: tuple[FieldRule, ...] = FIELD_RULES,
    fields: list[str] | None = None,
    status: str | None = None,
) -> DataFrame:
    """The heatmap: records with ``cells``, one ``(field, status)`` struct per shown field.

    ``fields`` narrows the shown fields; with a ``status`` only records with such a cell among them stay.
    """
    shown = _shown(rules, fields)
    judged = _normalized(df, tuple(shown)).withColumn(
        "cells", F.array(*[F.struct(F.lit(r.field).alias("field"), _status(r).alias("status")) for r in shown])
    )
    if status is not None:
        judged = judged.where(F.array_contains("cells.status", status))
    return judged.select(*df.columns, "cells")


def record_health(
    df: DataFrame, rules: tuple[FieldRule, ...] = FIELD_RULES, fields: list[str] | None = None
) -> DataFrame:
    """Add ``health``, the rounded percentage of complete cells among the shown fields. No shuffle."""
    shown = _shown(rules, fields)
    complete = sum((F.when(_status(r) == "complete", 1).otherwise(0) for r in shown), F.lit(0))
    health = half_up(F.try_divide(complete, F.lit(len(shown))) * 100)
    return _normalized(df, tuple(shown)).withColumn("health", health).select(*df.columns, "health")


def field_health(df: DataFrame, rules: tuple[FieldRule, ...] = FIELD_RULES) -> DataFrame:
    """Per field: counts and percentages of the four states, from one aggregate over one scan."""
    judged = _normalized(df, rules).select(*[_status(r).alias(f"s{i}") for i, r in enumerate(rules)])
    totals = judged.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col(f"s{i}") == s).alias(f"s{i}_{s}") for i, _ in enumerate(rules) for s in STATES],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(r.field).alias("field"),
                F.lit(r.required).alias("required"),
                F.col("records"),
                *[F.col(f"s{i}_{s}").alias(s) for s in STATES],
            )
            for i, r in enumerate(rules)
        ]
    )

    def pct(name: str) -> Column:
        return F.try_divide(F.col(name) * 100.0, F.col("records"))

    return (
        totals.select(F.inline(rows))
        .withColumn("null_pct", pct("missing"))
        .withColumn("invalid_pct", pct("invalid"))
        .withColumn("partial_pct", pct("partial"))
        .withColumn("complete_pct", pct("complete"))
        .withColumn("band", field_health_band(F.col("complete_pct")))
    )


def null_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: percentage of blank values, completeness and band."""
    totals = df.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(v.is_blank(F.col(c))).alias(f"blank_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.try_divide(F.col(f"blank_{i}") * 100.0, F.col("records")).alias("null_pct"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return (
        totals.select(F.inline(rows))
        .withColumn("completeness", 100 - F.col("null_pct"))
        .withColumn("band", null_band(F.col("null_pct")))
    )
