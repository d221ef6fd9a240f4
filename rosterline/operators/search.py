"""Structured record questions, recency filters and sorted review lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.bands import severity_rank
from rosterline.functions.text import moment
from rosterline.functions.validators import is_email, normalize


def matching(df: DataFrame, **values: str) -> DataFrame:
    """Rows where every named column equals its value: "list all X in Y"."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == x for c, x in values.items()], F.lit(True)))


def how_many(df: DataFrame, **values: str) -> DataFrame:
    return matching(df, **values).agg(F.count(F.lit(1)).alias("n"))


def invalid_emails(df: DataFrame, email: str = "email") -> DataFrame:
    """Rows with an e-mail that is filled but malformed."""
    value = normalize(F.col(email))
    return df.where((value != "") & ~is_email(value))


def since(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; there is no upper bound."""
    return df.where(F.col(column) >= moment(df, column, as_of) - F.expr(f"INTERVAL {days} DAYS"))


def with_expiry(exports: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Add whether an export is too old to be downloaded again."""
    oldest = moment(exports, "created_at", as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return exports.withColumn("expired", F.col("created_at") < oldest)


def of_type(audit: DataFrame, kind: str = "All") -> DataFrame:
    return audit if kind == "All" else audit.where(F.col("type") == kind)


def named_like(companies: DataFrame, text: str) -> DataFrame:
    """Organizations whose name contains the text in any case."""
    return companies.where(F.lower("name").contains(text.lower()))


def sort_key(name: str, kind: str = "") -> Column:
    """Severities go by rank and text as a reader sorts it."""
    if name == "severity":
        return severity_rank(F.col("severity"))
    return F.collate(F.col(name), "UNICODE") if kind == "string" else F.col(name)


def ordered(df: DataFrame, by: str, unique: str, descending: bool = True) -> DataFrame:
    """Review list by one column (severities by rank), ties by a unique column.

    The unique column also lets the range partitioner cut through runs of equal keys.
    """
    key = sort_key(by, dict(df.dtypes)[by])
    return df.orderBy(key.desc() if descending else key.asc(), F.col(unique))


def newest(df: DataFrame, time: str, unique: str, limit: int | None = None) -> DataFrame:
    sorted_rows = df.orderBy(F.col(time).desc(), F.col(unique).desc())
    return sorted_rows if limit is None else sorted_rows.limit(limit)
