"""Queries: dashboard, analytics, audit and segment reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.operators import search, segments, summary
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.plans.release import DECIDED, decided_flags

_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _seconds(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _open(category: str) -> str:
    return s.n_if(f"lower(category) = '{category}' AND NOT resolved")


@plan(
    s.sql(
        f"companies uploads {DECIDED}",
        f""", mine AS (SELECT * FROM uploads WHERE company_id IN (SELECT company_id FROM companies)),
        open AS (SELECT {", ".join(f"{_open(c)} AS {c}" for c in summary.CATEGORIES)} FROM decided
            WHERE company_id IN (SELECT company_id FROM companies))
        SELECT CAST(sum(coalesce(total_rows, 0)) AS BIGINT) AS total_hcps,
            CAST(coalesce(sum(total_rows) FILTER (WHERE created_at >= TIMESTAMP '{s.AS_OF}' - INTERVAL 7 DAYS), 0)
                AS BIGINT) AS records_this_week,
            round(avg(health_score), 1) AS health_score, {_TIME.format(c="max(created_at)")} AS last_upload,
            any_value(pii) AS pii, any_value(duplicates) AS duplicates, any_value(outliers) AS outliers,
            any_value(npi_validation) AS npi_validation,
            any_value(pii + duplicates + outliers + npi_validation) AS total_flags
        FROM mine, open""",
    )
)
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    board = summary.dashboard(s.uploads(spark, d), decided_flags(spark, d), s.companies(spark, d), s.AS_OF)
    return board.withColumn("last_upload", _seconds("last_upload"))


@plan(
    s.sql(
        "uploads",
        f"""SELECT upload_id, {_TIME.format(c="created_at")} AS created_at, round(health_score, 4) AS health_score
        FROM uploads WHERE health_score IS NOT NULL ORDER BY uploads.created_at DESC, upload_id DESC LIMIT 5""",
    )
)
def quality_trend(spark: SparkSession, d: str) -> DataFrame:
    trend = summary.quality_trend(s.uploads(spark, d))
    return trend.select("upload_id", _seconds("created_at"), F.round("health_score", 4).alias("health_score"))


@plan(
    s.sql(
        f"uploads {DECIDED}",
        """SELECT CAST(sum(coalesce(total_rows, 0)) AS BIGINT) AS total_records,
        round(avg(health_score), 1) AS mean_quality,
        any_value((SELECT count(*) FROM decided WHERE NOT resolved)) AS open_flags FROM uploads""",
    )
)
def analytics_cards(spark: SparkSession, d: str) -> DataFrame:
    return summary.analytics_cards(s.uploads(spark, d), decided_flags(spark, d))


_ORGS = """SELECT companies.*, coalesce(users, 0) AS users, coalesce(records, 0) AS records FROM companies
    LEFT JOIN (SELECT n_name AS company_id, count(*) AS users FROM supplier JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1) USING (company_id)
    LEFT JOIN (SELECT n_name AS company_id, count(*) AS records FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1) USING (company_id)"""


def _organizations(spark: SparkSession, d: str) -> DataFrame:
    """Companies with their users (suppliers) and records (customers)."""
    nation = spark.read.parquet(f"{d}/nation.parquet")

    def per_nation(name: str, key: str, alias: str) -> DataFrame:
        rows = spark.read.parquet(f"{d}/{name}.parquet").groupBy(F.col(key).alias("n_nationkey"))
        counted = rows.agg(F.count(F.lit(1)).alias(alias)).join(nation, "n_nationkey")
        return counted.select(F.col("n_name").alias("company_id"), alias)

    users = per_nation("supplier", "s_nationkey", "users")
    records = per_nation("customer", "c_nationkey", "records")
    joined = s.companies(spark, d).join(users, "company_id", "left").join(records, "company_id", "left")
    return joined.fillna(0, ["users", "records"])


@plan(
    s.sql(
        "companies",
        f""", orgs AS ({_ORGS}) SELECT count(*) AS orgs, {s.n_if("status = 'active'")} AS active_orgs,
        CAST(sum(users) AS BIGINT) AS users, CAST(sum(records) AS BIGINT) AS records FROM orgs""",
    )
)
def platform_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summary.platform_rollup(_organizations(spark, d))


@plan(
    s.sql(
        "companies",
        f""", orgs AS ({_ORGS}) SELECT company_id, name, plan, users, records FROM orgs
        WHERE contains(lower(name), 'tion_1')""",
    )
)
def organization_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.named_like(_organizations(spark, d), "TION_1")
    return found.select("company_id", "name", "plan", "users", "records")


@plan(
    s.sql(
        f"{DECIDED} records",
        f""", done AS (SELECT {s.n_if("lower(category) = 'pii' AND resolved")} AS pii_resolved,
            {s.n_if("lower(category) = 'duplicates' AND action = 'merged'")} AS duplicates_merged,
            {s.n_if("action = 'warned'")} AS warnings, {_open("npi_validation")} AS npi_open FROM decided)
        SELECT total_records, pii_resolved, duplicates_merged, warnings,
            round(100 - npi_open * 100.0 / total_records, 1) AS npi_pass_rate
        FROM done, (SELECT count(*) AS total_records FROM records)""",
    )
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    total = s.records(spark, d).agg(F.count(F.lit(1))).scalar()
    return summary.audit_report(decided_flags(spark, d), total)


_BAND = """CASE WHEN volume >= 3000000 THEN 'high volume' WHEN volume >= 1500000 THEN 'medium volume'
    ELSE 'low volume' END"""


def _mode_sql(column: str) -> str:
    return f"""(SELECT segment, {column}, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, {column}) AS rn
        FROM banded GROUP BY 1, 2)"""


@plan(
    s.sql(
        "providers",
        f""", banded AS (SELECT *, {_BAND} AS segment FROM providers)
        SELECT segment, size, specialty, region FROM (SELECT segment, count(*) AS size FROM banded GROUP BY 1)
        JOIN {_mode_sql("specialty")} AS a USING (segment) JOIN {_mode_sql("region")} AS b USING (segment)
        WHERE a.rn = 1 AND b.rn = 1""",
    )
)
def segment_profile(spark: SparkSession, d: str) -> DataFrame:
    banded = s.providers(spark, d).withColumn("segment", F.expr(_BAND))
    return segments.profile(banded, "segment", "specialty", "region")


@plan()
def provider_segments(spark: SparkSession, d: str) -> DataFrame:
    """K-means segments of all providers, profiled."""
    clustered = segments.segment(s.providers(spark, d), ["specialty", "region"], ["volume", "orders"])
    return segments.profile(clustered, "segment", "specialty", "region")


@plan(
    """SELECT count(*) AS providers, sum(orders)::BIGINT AS orders, true AS at_most_six, true AS none_empty
    FROM (SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""
)
def provider_segment_totals(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any k-means segments: each provider is in one of at most six, and none is empty."""
    clustered = segments.segment(s.providers(spark, d), ["specialty", "region"], ["volume", "orders"])
    sizes = clustered.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders"))
    return sizes.agg(
        F.sum("n").alias("providers"),
        F.sum("orders").alias("orders"),
        (F.count(F.lit(1)) <= 6).alias("at_most_six"),
        (F.min("n") > 0).alias("none_empty"),
    )


_ROUNDS, _SEGMENTS = 2, 6
_UNITS = "CAST(floor(1000 * ({c} - avg_{c}) / sd_{c} + 0.5) AS BIGINT) AS {c}"
_PLACE = "md5(CAST(provider_id AS VARCHAR))"


def _round_sql(i: int) -> str:
    """Assignment to the prototypes of round i - 1, and those of round i; a segment without rows keeps its own."""

    def mode(column: str) -> str:
        return f"""(SELECT segment, {column}, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, {column} NULLS FIRST) AS rn
            FROM near{i} GROUP BY 1, 2)"""

    return f""", near{i} AS (SELECT * FROM (SELECT points.*, p.segment, row_number() OVER (PARTITION BY provider_id ORDER BY
            (points.volume - p.volume) * (points.volume - p.volume) + (points.orders - p.orders) * (points.orders - p.orders)
            + CASE WHEN points.specialty IS DISTINCT FROM p.specialty THEN 500000 ELSE 0 END
            + CASE WHEN points.region IS DISTINCT FROM p.region THEN 500000 ELSE 0 END, p.segment) AS rn
            FROM points, at{i - 1} AS p) WHERE rn = 1),
        moved{i} AS (SELECT segment, a.specialty, b.region, m.volume, m.orders FROM (SELECT segment,
            CAST(floor(CAST(sum(volume) AS DOUBLE) / count(*)) AS BIGINT) AS volume,
            CAST(floor(CAST(sum(orders) AS DOUBLE) / count(*)) AS BIGINT) AS orders FROM near{i} GROUP BY 1) AS m
            JOIN {mode("specialty")} AS a USING (segment) JOIN {mode("region")} AS b USING (segment)
            WHERE a.rn = 1 AND b.rn = 1),
        at{i} AS (SELECT * FROM moved{i} UNION ALL SELECT segment, specialty, region, volume, orders FROM at{i - 1}
            WHERE segment NOT IN (SELECT segment FROM moved{i}))"""


@plan(
    s.sql(
        "providers",
        f""", points AS (SELECT provider_id, specialty, region, {_UNITS.format(c="volume")}, {_UNITS.format(c="orders")}
            FROM providers, (SELECT avg(volume) AS avg_volume, stddev_pop(volume) AS sd_volume,
            avg(orders) AS avg_orders, stddev_pop(orders) AS sd_orders FROM providers)),
        tries AS (SELECT * FROM points ORDER BY {_PLACE} LIMIT {segments.TRIES * _SEGMENTS}),
        at0 AS (SELECT row_number() OVER (ORDER BY place) - 1 AS segment, specialty, region, volume, orders FROM
            (SELECT specialty, region, volume, orders, min({_PLACE}) AS place FROM tries GROUP BY 1, 2, 3, 4
            ORDER BY place LIMIT {_SEGMENTS}))
        {"".join(_round_sql(i) for i in range(1, _ROUNDS + 2))}
        SELECT provider_id, segment FROM near{_ROUNDS + 1}""",
    )
)
def provider_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Segment of every provider after two rounds from the fixed start."""
    found = segments.prototypes(s.providers(spark, d), "provider_id", ["specialty", "region"], ["volume", "orders"], _SEGMENTS, _ROUNDS)
    return found.select("provider_id", "segment")
