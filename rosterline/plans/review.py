"""Queries: flags, decisions, scores and sorted review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import bands
from rosterline.operators import review, score, search, summary
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.plans.release import DECIDED, decided_flags


@plan(s.sql("resolutions latest", "SELECT flag_id, action, seq, master FROM latest"))
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.latest(s.resolutions(spark, d)).select("flag_id", "action", "seq", "master")


@plan(s.sql(DECIDED, "SELECT flag_id, coalesce(action, 'open') AS action, resolved FROM decided"))
def flag_decisions(spark: SparkSession, d: str) -> DataFrame:
    decided = decided_flags(spark, d)
    return decided.select("flag_id", F.coalesce("action", F.lit("open")).alias("action"), "resolved")


@plan(s.sql(DECIDED, "SELECT flag_id, category FROM decided WHERE NOT resolved"))
def open_flags(spark: SparkSession, d: str) -> DataFrame:
    return review.open_flags(decided_flags(spark, d)).select("flag_id", "category")


@plan(
    s.sql(
        "flags resolutions accepted",
        "SELECT flag_id, seq, action, justification FROM accepted",
    )
)
def accepted_overrides(spark: SparkSession, d: str) -> DataFrame:
    accepted = review.accepted_overrides(s.resolutions(spark, d), s.flags(spark, d))
    return accepted.select("flag_id", "seq", "action", "justification")


@plan(
    s.sql(
        f"{DECIDED} records",
        "SELECT record_id, npi FROM records WHERE record_id NOT IN (SELECT record_id FROM decided WHERE action = 'removed')",
    )
)
def records_after_removal(spark: SparkSession, d: str) -> DataFrame:
    return review.drop_removed(s.records(spark, d), decided_flags(spark, d)).select("record_id", "npi")


@plan(
    s.sql(
        f"{DECIDED} records",
        """, hidden AS (SELECT record_id, field FROM decided WHERE action = 'anonymized')
        SELECT record_id, """
        + ", ".join(f"CASE WHEN field = '{c}' THEN sha256({c}) ELSE {c} END AS {c}" for c in ("email", "phone", "address"))
        + " FROM records LEFT JOIN hidden USING (record_id)",
    )
)
def anonymized_records(spark: SparkSession, d: str) -> DataFrame:
    fields = ["email", "phone", "address"]
    masked = review.anonymize(s.records(spark, d), decided_flags(spark, d), fields)
    return masked.select("record_id", *fields)


@plan(
    s.sql(
        DECIDED,
        f"""SELECT lower(category) AS category, count(*) AS total, {s.n_if("resolved")} AS resolved,
        {s.n_if("NOT resolved")} AS open FROM decided GROUP BY 1""",
    )
)
def open_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = decided_flags(spark, d).withColumn("category", F.lower("category"))
    return review.open_counts(flags, ["category"])


@plan(
    s.sql(
        DECIDED,
        f"""SELECT n_name AS company_id, count(flag_id) AS total, {s.n_if("resolved")} AS resolved,
        {s.n_if("NOT resolved")} AS open FROM nation LEFT JOIN (SELECT * FROM decided WHERE company_id <> 'CHINA')
        ON company_id = n_name GROUP BY 1""",
    )
)
def open_counts_by_company(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every tenant; one of them has no flags."""
    flags = decided_flags(spark, d).where("company_id <> 'CHINA'")
    return review.open_counts(flags, ["company_id"], s.table(spark, d, "nation").select(F.col("n_name").alias("company_id")))


@plan(
    s.sql(
        DECIDED,
        ", ".join(
            f"greatest(0, {s.n_if(f'lower(category) = {chr(39)}{c}{chr(39)}')} - {s.n_if(f'lower(category) = {chr(39)}{c}{chr(39)} AND resolved')}) AS {c}"
            for c in summary.CATEGORIES
        ).join(["SELECT ", f", {s.n_if('lower(category) IN (' + ', '.join(repr(c) for c in summary.CATEGORIES) + ') AND NOT resolved')} AS total_flags FROM decided"]),
    )
)
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.flag_counts(decided_flags(spark, d))


_CATEGORY_SQL = """, weights (category, max_points) AS (VALUES ('npi_validation', 30), ('pii', 25), ('duplicates', 25),
        ('outliers', 20)),
    weighted AS (SELECT company_id, lower(category) AS category, resolved, CASE WHEN lower(category) = 'duplicates' THEN 1
        WHEN severity = 'High' THEN 3 WHEN severity = 'Medium' THEN 2 ELSE 1 END AS w FROM decided)"""


@plan(
    s.sql(
        DECIDED,
        _CATEGORY_SQL
        + """SELECT weights.category, count(w) AS flags, CAST(max_points AS DOUBLE) AS max_points,
        round(coalesce(sum(CASE WHEN resolved THEN w ELSE 0 END) / sum(w), 1.0) * max_points, 4) AS points
        FROM weights LEFT JOIN weighted USING (category) GROUP BY weights.category, max_points""",
    )
)
def category_points(spark: SparkSession, d: str) -> DataFrame:
    points = score.category_points(decided_flags(spark, d))
    return points.withColumn("points", F.round("points", 4))


def _score_sql(group: str, sizes: str) -> str:
    return (
        _CATEGORY_SQL
        + f""", sizes AS ({sizes}), points AS (SELECT {group} AS g, category, max_points, count(w) AS n,
            coalesce(sum(CASE WHEN resolved THEN w ELSE 0 END) / sum(w), 1.0) * max_points AS p
            FROM sizes CROSS JOIN weights LEFT JOIN weighted ON weighted.category = weights.category
                AND (sizes.g IS NULL OR weighted.company_id = sizes.g)
            GROUP BY 1, 2, 3)"""
    ).replace(f"SELECT {group} AS g, category", f"SELECT {group} AS g, weights.category")


_FINAL = """greatest(0, least(100, floor(sum(p) - least(5.0, sum(n) / (any_value(total_rows) / 1000.0) * 0.4) + 0.5)))"""
_LABEL = "CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 65 THEN 'Good' WHEN score >= 45 THEN 'Fair' ELSE 'Poor' END"


@plan(
    s.sql(
        DECIDED + " records",
        _score_sql("sizes.g", "SELECT CAST(NULL AS VARCHAR) AS g, count(*) AS total_rows FROM records")
        + f"""SELECT flags, score, {_LABEL} AS label FROM (SELECT CAST(sum(n) AS BIGINT) AS flags,
        CAST({_FINAL} AS BIGINT) AS score FROM points, sizes)""",
    )
)
def health_score(spark: SparkSession, d: str) -> DataFrame:
    sizes = s.records(spark, d).agg(F.count(F.lit(1)).alias("total_rows"))
    return score.health_score(decided_flags(spark, d), sizes)


@plan(
    s.sql(
        DECIDED + " records",
        _score_sql("sizes.g", "SELECT company_id AS g, count(*) AS total_rows FROM records GROUP BY 1")
        + f"""SELECT g AS company_id, flags, score, {_LABEL} AS label FROM (SELECT points.g, CAST(sum(n) AS BIGINT) AS flags,
        CAST({_FINAL} AS BIGINT) AS score FROM points JOIN sizes ON points.g = sizes.g GROUP BY 1)""",
    )
)
def health_score_by_company(spark: SparkSession, d: str) -> DataFrame:
    sizes = s.records(spark, d).groupBy("company_id").agg(F.count(F.lit(1)).alias("total_rows"))
    return score.health_score(decided_flags(spark, d), sizes, ["company_id"])


@plan(
    s.sql(
        "uploads",
        """SELECT upload_id, CASE WHEN health_score >= 85 THEN 'Excellent' WHEN health_score >= 65 THEN 'Good'
        WHEN health_score >= 45 THEN 'Fair' ELSE 'Poor' END AS label,
        CASE WHEN 100 - health_score = 0 THEN 'success' WHEN 100 - health_score <= 5 THEN 'warning' ELSE 'danger' END
        AS null_band, CASE WHEN health_score >= 90 THEN 'success' WHEN health_score >= 70 THEN 'warning'
        ELSE 'danger' END AS health_band FROM uploads WHERE health_score IS NOT NULL""",
    )
)
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    points = F.col("health_score")
    return (
        s.uploads(spark, d)
        .where(points.isNotNull())
        .select(
            "upload_id",
            bands.score_label(points).alias("label"),
            bands.null_band(100 - points).alias("null_band"),
            bands.field_health_band(points).alias("health_band"),
        )
    )


_RANK = "CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"


def _category(spark: SparkSession, d: str, name: str) -> DataFrame:
    return s.flags(spark, d).where(F.lower("category") == name)


def _list_sql(category: str, key: str) -> str:
    return s.sql(
        "flags",
        f"SELECT flag_id, severity, score FROM flags WHERE lower(category) = '{category}' ORDER BY {key} DESC, flag_id",
    )


@plan(_list_sql("pii", _RANK))
def pii_review_list(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_category(spark, d, "pii"), "severity", "flag_id").select("flag_id", "severity", "score")


@plan(_list_sql("outliers", "score"))
def outlier_review_list(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_category(spark, d, "outliers"), "score", "flag_id").select("flag_id", "severity", "score")


@plan(_list_sql("npi_validation", _RANK))
def npi_review_list(spark: SparkSession, d: str) -> DataFrame:
    listed = search.ordered(_category(spark, d, "npi_validation"), "severity", "flag_id")
    return listed.select("flag_id", "severity", "score")


@plan(s.sql("audit", "SELECT event_id, actor, type FROM audit ORDER BY ts DESC, event_id DESC LIMIT 5"))
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return search.newest(s.audit(spark, d), "ts", "event_id", 5).select("event_id", "actor", "type")


@plan(s.sql("audit", "SELECT event_id, actor, resource FROM audit WHERE type = 'purchase'"))
def audit_of_type(spark: SparkSession, d: str) -> DataFrame:
    return search.of_type(s.audit(spark, d), "purchase").select("event_id", "actor", "resource")
