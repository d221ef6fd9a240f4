"""Dashboard, analytics and audit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.bands import half_up
from rosterline.functions.text import first_filled, instant
from rosterline.operators import score

# Flag categories of the dashboard.
CATEGORIES = ("pii", "duplicates", "outliers", "npi_validation")


def flag_counts(flags: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """One row: unresolved flags per known category and in total; other categories do not count."""
    if companies is not None:
        flags = flags.join(companies, "company_id", "left_semi")
    category = F.lower("category")
    is_open = ~F.coalesce("resolved", F.lit(False))
    return flags.agg(
        *[F.count_if(is_open & (category == c)).alias(c) for c in CATEGORIES],
        F.count_if(is_open & category.isin(*CATEGORIES)).alias("total_flags"),
    )


def upload_totals(uploads: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """One row: rows in total and in the seven days before ``as_of``, mean health, last upload.

    Health is the plain mean over uploads that have a score. ``created_at``, or ``uploaded_at`` where it
    is empty, may be text; what cannot be read as a time counts in the totals but is neither recent nor last.
    """
    known = uploads.join(companies, "company_id", "left_semi")
    given = [F.col(c) for c in ("created_at", "uploaded_at") if c in uploads.columns]
    if "string" in {dict(uploads.dtypes)[c] for c in ("created_at", "uploaded_at") if c in uploads.columns}:
        created = instant(first_filled(*given))
    else:
        created = F.coalesce(*given)
    rows = F.coalesce(F.col("total_rows").cast("long"), F.lit(0))
    week_ago = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return known.select(rows.alias("n"), "health_score", created.alias("t")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_hcps"),
        F.coalesce(F.sum(F.when(F.col("t") >= week_ago, F.col("n"))), F.lit(0)).alias("records_this_week"),
        F.coalesce(F.bround(F.avg("health_score"), 1), F.lit(0.0)).alias("health_score"),
        F.max("t").alias("last_upload"),
    )


def dashboard(uploads: DataFrame, flags: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """The two one-row summaries side by side."""
    totals = upload_totals(uploads, companies, as_of)
    counted = flag_counts(flags, companies)
    names = [*totals.columns, *counted.columns]
    both = totals.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names])


def top_shares(df: DataFrame, column: str, top: int = 4) -> DataFrame:
    """Percentage of rows per value: the most frequent values and ``Other`` for the rest."""
    counted = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # `top` rows at most, so broadcasting them is safe
    named = counted.where(F.trim(F.col("name").cast("string")) != "")  # a missing value takes no place, it counts as Other
    leading = named.orderBy(F.desc("n"), "name").limit(top).select(F.col("name").alias("lead"))
    grouped = (
        counted.join(F.broadcast(leading), F.col("name") == F.col("lead"), "left")
        .groupBy(F.coalesce("lead", F.lit("Other")).alias("name"))
        .agg(F.sum("n").alias("n"))
    )
    total = counted.agg(F.sum("n")).scalar()
    return grouped.select("name", "n", F.try_divide(F.col("n") * 100.0, total).alias("pct"))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The value with most rows; the alphabetically first one on ties."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(1)


def density(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, scaled so that the largest is 100."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    largest = counted.agg(F.max("n")).scalar()
    return counted.withColumn("density", half_up(F.try_divide(F.col("n") * 100.0, largest)))


def quality_trend(uploads: DataFrame, last: int = 5) -> DataFrame:
    """The newest uploads that have a score, oldest of them first."""
    newest = (
        uploads.where("health_score IS NOT NULL")
        .select("upload_id", "created_at", "health_score")
        .orderBy(F.desc("created_at"), F.desc("upload_id"))
        .limit(last)
    )
    return newest.orderBy("created_at", "upload_id")


def analytics_cards(uploads: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: rows in total, mean quality over uploads with a score, and open flags."""
    open_flags = flags.agg(F.count_if(~F.coalesce("resolved", F.lit(False)))).scalar()
    return uploads.agg(
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_records"),
        F.coalesce(F.bround(F.avg("health_score"), 1), F.lit(0.0)).alias("mean_quality"),
    ).withColumn("open_flags", open_flags)


def platform_rollup(companies: DataFrame) -> DataFrame:
    return companies.agg(
        F.count(F.lit(1)).alias("orgs"),
        F.count_if(F.col("status") == "active").alias("active_orgs"),
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )


def audit_report(flags: DataFrame, total_records: Column, quality_score: Column | None = None) -> DataFrame:
    """One row: what was resolved, the share of records without an open provider-number error and the list's score."""
    category = F.lower("category")
    done = F.col("resolved")
    npi_open = F.count_if((category == "npi_validation") & ~done)
    return flags.agg(
        F.count_if((category == "pii") & done).alias("pii_resolved"),
        F.count_if((category == "duplicates") & (F.col("action") == "merged")).alias("duplicates_merged"),
        F.count_if(F.col("action") == "warned").alias("warnings"),
        npi_open.alias("npi_open"),
    ).select(
        total_records.alias("total_records"),
        "pii_resolved",
        "duplicates_merged",
        "warnings",
        F.bround(100 - F.try_divide(F.col("npi_open") * 100.0, total_records), 1).alias("npi_pass_rate"),
        *([] if quality_score is None else [quality_score.alias("quality_score")]),
    )


def partials(records: DataFrame, flags: DataFrame, by: str = "company_id") -> DataFrame:
    """Rows and flag sums of one upload per tenant: all that dashboard and score need of it."""
    is_open = ~F.coalesce("resolved", F.lit(False))
    counted = flags.groupBy(by).agg(*[F.count_if(is_open & (F.lower("category") == c)).alias(f"{c}_open") for c in CATEGORIES])
    sums = score.sums_of(flags, [by]).join(counted, by)
    sizes = records.groupBy(by).agg(F.count(F.lit(1)).alias("total_rows"))
    joined = sizes.join(sums, by, "full")
    return joined.fillna(0, [c for c in joined.columns if c != by])


def store(partial: DataFrame, path: str, upload: str) -> None:
    """Keep the sums of an upload; the same upload again, or after further decisions, takes the place of its earlier ones."""
    partial.write.mode("overwrite").parquet(f"{path}/upload={upload}")


def combined(spark: SparkSession, path: str, by: str = "company_id") -> DataFrame:
    """Sums over all stored uploads; reads one row per upload and tenant, no records."""
    kept = spark.read.parquet(path).drop("upload")
    return kept.groupBy(by).agg(*[F.sum(c).alias(c) for c in kept.columns if c != by])


def warned_records(records: DataFrame, decided: DataFrame, key: str = "record_id") -> DataFrame:
    """The report's list of records that leave with a warning: name, specialty, score, reason and note of each warning."""
    warned = decided.where("action = 'warned'").select(key, "score", "reason", "note")
    name = F.concat_ws(" ", "first_name", "last_name")
    return records.select(key, name.alias("name"), "specialty").join(warned, key)
