"""Semantic column types from header names and value statistics.

All columns are counted in one aggregate over one scan; the decision is an expression on the few
resulting rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.validators import CHECKS, normalize

# Shares of non-empty values that make a match certain or just acceptable.
CERTAIN = 0.9
ACCEPTABLE = 0.5

# Header names, in lower case, that name a type.
HEADER_NAMES = {
    "npi": ("npi", "provider_id", "providerid", "physician_id", "physicianid", "md_number"),
    "email": ("email", "email_address", "emailaddress", "e_mail"),
    "phone": ("phone", "phone_number", "phonenumber", "telephone", "mobile", "cell"),
    "practiceState": ("practice_state", "practicestate", "state", "practice_location_state", "location_state"),
    "firstName": ("first_name", "firstname", "fname", "given_name", "givenname"),
    "lastName": ("last_name", "lastname", "lname", "surname", "family_name", "familyname"),
    "specialty": ("specialty", "speciality", "provider_specialty", "medical_specialty"),
    "boolean": (
        "has_opted_in",
        "hasoptedin",
        "opted_in",
        "optedin",
        "opt_in",
        "optin",
        "consent",
        "agreement",
        "active",
    ),
}

# Checks that are counted separately; the two name types share one check.
COUNTED = [name for name in CHECKS if name != "lastName"]


def header_type(column: str) -> str | None:
    """Type named by a header, if any. Looks at schema names only, never at data."""
    name = column.lower()
    return next((kind for kind, names in HEADER_NAMES.items() if name in names), None)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: number of rows, of non-empty values and of matches per type.

    The cells of a row are unfolded and counted per column position. That keeps the plan small for
    any number of columns, and each task sends on one row per column. Where the header decides alone, no value is
    checked and the matches are NULL.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)

    def text(column: str) -> Column:
        cell = F.col(f"`{column}`")
        if kinds.get(column) in ("float", "double"):  # a NaN is an empty cell
            cell = F.nanvl(cell, F.lit(None))
        return normalize(cell)

    value = F.col("value")
    settled = [i for i, c in enumerate(columns) if header_type(c) not in (None, "boolean")]
    undecided = ~F.col("ordinal").isin(settled) if settled else F.lit(True)
    counted = (
        df.select(F.posexplode(F.array(*[text(c) for c in columns])).alias("ordinal", "value"))
        .groupBy("ordinal")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(value != "").alias("non_empty"),
            *[F.count_if(undecided & CHECKS[kind](value)).alias(kind) for kind in COUNTED],
        )
    )
    # from the names, so that a table without rows still reports every column; there is one counted
    # row per column at most, which bounds the broadcast
    names = df.sparkSession.createDataFrame(
        [(i, c, header_type(c)) for i, c in enumerate(columns)], "ordinal int, column string, header_type string"
    )
    counts = ["records", "non_empty", *COUNTED]
    return (
        names.join(F.broadcast(counted), "ordinal", "left")
        .fillna(0, counts)
        .withColumns({kind: F.when(undecided, F.col(kind)) for kind in COUNTED})
        .select("ordinal", "column", "header_type", *counts, F.col("firstName").alias("lastName"))
    )


def merge_counts(states: DataFrame) -> DataFrame:
    """:func:`value_counts` of several files of a list as those of the whole; a column goes by its name, not its place."""
    counts = ["records", "non_empty", *CHECKS]
    return states.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.first("header_type").alias("header_type"), *[F.sum(c).alias(c) for c in counts]
    )


def decide(counts: DataFrame) -> DataFrame:
    """Add the inferred type to the rows of :func:`value_counts`.

    A header name decides at once, except that a boolean header needs certain values. Otherwise the
    type with most matches wins, the earlier one on ties, if at least half of the values match. ``best_share`` is NULL
    where the header decided.
    """
    ranked = F.array_max(
        F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind"))
                  for i, k in enumerate(CHECKS)])
    )
    share = F.try_divide(ranked["n"], F.col("non_empty"))
    boolean_share = F.try_divide(F.col("boolean"), F.col("non_empty"))
    named = F.when(F.col("header_type") != "boolean", F.col("header_type")).when(
        (F.col("header_type") == "boolean") & (boolean_share >= CERTAIN), F.lit("boolean")
    )
    by_value = F.when(share >= ACCEPTABLE, ranked["kind"])
    best = F.when(F.coalesce("header_type", F.lit("boolean")) == "boolean", F.coalesce(share, F.lit(0.0)))
    return counts.withColumn("best_share", best).withColumn(
        "inferred_type", F.coalesce(named, by_value, F.lit("string"))
    )


def infer_types(
    df: DataFrame,
    columns: list[str] | None = None,
    sample_rows: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Semantic type of every column, from all rows or from the first ``sample_rows`` in an order."""
    if sample_rows is not None:
        if not order_by:
            raise ValueError("a sample of first rows needs order_by")
        df = df.orderBy(*order_by).limit(sample_rows)
    return decide(value_counts(df, columns or df.columns))
