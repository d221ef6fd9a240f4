"""Personal data in free text and in named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.validators import is_blank

# The names of the kinds and their severities, here and in the rules by column name below.
# What is searched in text: field, type, severity, pattern. An address is only tried at the start of a
# run of its characters and never again inside it, so that long texts take linear time.
TEXT_RULES = (
    ("SSN", "Social Security Number", "High", r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"),
    ("Credit Card", "Financial Identifier", "High", r"(?<![A-Za-z0-9_-])(?:[0-9]{4}[ -]?){3}[0-9]{1,4}(?![A-Za-z0-9_])"),
    ("Personal Email", "Personal Identifier", "Low", r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
)

# What a text must contain for a rule to be worth trying; most texts hold nothing and stop here.
HINTS = {"SSN": "[0-9]-[0-9]", "Credit Card": "[0-9]{4}", "Personal Email": "@"}

# What a column holds by its name: field, type, severity, column names.
COLUMN_RULES = (
    ("DOB", "Date of Birth", "Medium", ("dob", "date_of_birth", "birth_date", "birthdate")),
    ("Home Address", "Physical Address", "High", ("home_address", "residential_address")),
    ("SSN", "Social Security Number", "High", ("ssn", "social_security_number")),
)


def _found(text: Column, rule: tuple[str, str, str, str]) -> Column:
    field, kind, severity, pattern = rule
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = F.when(text.rlike(HINTS[field]), hits).otherwise(F.array().cast("array<string>"))
    if field == "Credit Card":
        digits = lambda h: F.regexp_replace(h, "[ -]", "")
        hits = F.filter(hits, lambda h: F.call_function("luhn_check", digits(h)))
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(field).alias("field"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), h.alias("value")
        ),
    )


def in_text(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per hit in the whole text: ``keys, field, type, severity, value``."""
    hits = F.concat(*[_found(F.col(text), rule) for rule in TEXT_RULES])
    return df.select(*keys, F.inline(hits))


def in_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per filled cell of a column whose name says it holds personal data."""
    named = [
        (field, kind, severity, column)
        for field, kind, severity, names in COLUMN_RULES
        for column in df.columns
        if column.lower() in names
    ]
    hits = [
        F.when(
            ~is_blank(F.col(column)),
            F.struct(
                F.lit(field).alias("field"),
                F.lit(kind).alias("type"),
                F.lit(severity).alias("severity"),
                F.col(column).cast("string").alias("value"),
            ),
        )
        for field, kind, severity, column in named
    ]
    if not hits:
        nothing = "field string, type string, severity string, value string"
        return df.select(*keys, F.inline(F.array().cast(f"array<struct<{nothing.replace(' string', ':string')}>>")))
    return df.select(*keys, F.inline(F.array_compact(F.array(*hits))))


def hits(columns: dict[str, str], texts: tuple[str, ...] = ()) -> Column:
    """``column, field, type, severity`` of all personal data in a row, once per column and kind.

    ``columns`` gives the name that tells what a column holds, ``texts`` are searched.
    """
    nothing = F.array().cast("array<struct<column:string,field:string,type:string,severity:string>>")

    def entry(column: str, field: Column, kind: Column, severity: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), field.alias("field"), kind.alias("type"), severity.alias("severity"))

    named = [
        F.when(~is_blank(F.col(column)), entry(column, F.lit(field), F.lit(kind), F.lit(severity)))
        for column, name in columns.items()
        for field, kind, severity, names in COLUMN_RULES
        if name.lower() in names
    ]

    def in_cell(column: str) -> Column:
        found = F.concat(*[_found(F.col(column), rule) for rule in TEXT_RULES])
        return F.transform(F.coalesce(found, F.array()), lambda h: entry(column, h["field"], h["type"], h["severity"]))

    filled = F.array_compact(F.array(*named)) if named else nothing
    return F.array_distinct(F.concat(nothing, filled, *[in_cell(c) for c in texts]))
