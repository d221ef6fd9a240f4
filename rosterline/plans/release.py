"""Queries: consent, exports, gates and export history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.operators import review, search
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.runtime import scratch, table
from rosterline.sources import exports

EVENTS_AS_OF = "2024-01-30 12:00:00"
DECIDED = "flags resolutions accepted effective decided"


def decided_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = s.flags(spark, d)
    return review.with_decision(flags, review.latest(review.accepted_overrides(s.resolutions(spark, d), flags)))


@plan(
    s.sql(
        "consent_documents",
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars, 'True' AS has_opted_in
        FROM consent_documents WHERE has_opted_in""",
    )
)
def consent_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.for_crm(s.consent_documents(spark, d))


@plan(s.sql("records", "SELECT record_id, npi, company_id FROM records WHERE has_opted_in"))
def consent_filter(spark: SparkSession, d: str) -> DataFrame:
    return exports.opted_in(s.records(spark, d)).select("record_id", "npi", "company_id")


@plan(s.sql("records", "SELECT record_id, npi FROM records WHERE false"))
def consent_column_missing(spark: SparkSession, d: str) -> DataFrame:
    return exports.opted_in(s.records(spark, d).select("record_id", "npi"))


@plan(
    s.sql(
        "companies records",
        f"""SELECT company_id, count(record_id) AS records, {s.n_if("has_opted_in")} AS exported,
        CASE WHEN count(record_id) = 0 THEN 'not_found' WHEN {s.n_if("has_opted_in")} = 0 THEN 'empty' ELSE 'ok' END
        AS status FROM (SELECT company_id FROM companies UNION SELECT 'NATION_99')
        LEFT JOIN (SELECT * FROM records WHERE NOT (company_id = 'NATION_3' AND coalesce(has_opted_in, false)))
        USING (company_id) GROUP BY 1""",
    )
)
def export_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome per company; one has no consenting record and one has no records at all."""
    companies = s.companies(spark, d).select("company_id")
    named = companies.unionByName(companies.limit(1).select(F.lit("NATION_99").alias("company_id")))
    kept = ~((F.col("company_id") == "NATION_3") & F.coalesce("has_opted_in", F.lit(False)))
    return exports.outcomes(named, s.records(spark, d).where(kept))


_CSV_CELL = """CASE WHEN regexp_matches({c}, '[",\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_CSV_ROW = ["record_id", "npi", "first_name", "last_name", "specialty", "state", "email", "phone", "address", "has_opted_in"]


@plan(
    s.sql(
        "records",
        "SELECT concat_ws(',', "
        + ", ".join(
            ("'True'" if c == "has_opted_in" else _CSV_CELL.format(c=f"coalesce(trim(CAST({c} AS VARCHAR)), '')"))
            for c in _CSV_ROW
        )
        + """) AS line, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN volume > 300000
            THEN address || ', "Suite" ' || record_id ELSE address END AS address) FROM records)
            WHERE has_opted_in GROUP BY 1""",
    )
)
def crm_csv_file(spark: SparkSession, d: str) -> DataFrame:
    """The written CSV, line by line without its header; some cells hold commas and quotes."""
    path = scratch(spark, "crm-export")
    address = "CASE WHEN volume > 300000 THEN concat(address, ', \"Suite\" ', record_id) ELSE address END"
    rows = s.records(spark, d).withColumn("address", F.expr(address)).withColumn("specialty", F.trim("specialty"))
    exports.write_csv(exports.for_crm(rows.select(*_CSV_ROW)), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(F.col("line") != ",".join(_CSV_ROW)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_WARNED = """, warned AS (SELECT record_id, CASE WHEN coalesce(trim(note), '') = '' THEN 'No note provided' ELSE note END
        AS note FROM decided WHERE action = 'warned'),
    tagged AS (SELECT records.*, CASE WHEN note IS NULL THEN '' ELSE '[DATA QUALITY WARNING]' END AS dq_flag,
        note AS dq_note FROM records LEFT JOIN warned USING (record_id))"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return review.tag_warnings(s.records(spark, d), review.quality_warnings(decided_flags(spark, d)))


@plan(
    s.sql(
        f"{DECIDED} records",
        _WARNED
        + "SELECT "
        + ", ".join(f"coalesce({c}, '') AS \"{n}\"" for c, n in exports.CLEAN_COLUMNS.items())
        + " FROM tagged",
    )
)
def clean_list(spark: SparkSession, d: str) -> DataFrame:
    return exports.clean_list(_tagged(spark, d))


@plan(
    s.sql(
        f"{DECIDED} records",
        _WARNED
        + f"""SELECT count(*) AS records, {s.n_if("dq_flag <> ''")} AS dq_warnings,
        concat('# ', format('{{:,}}', count(*)), ' total records · ', {s.n_if("dq_flag <> ''")},
            ' DQ warnings · Role: Admin') AS trailer FROM tagged""",
    )
)
def clean_list_summary(spark: SparkSession, d: str) -> DataFrame:
    return exports.clean_list_summary(_tagged(spark, d), "Admin")


@plan(
    s.sql(
        f"{DECIDED} records",
        _WARNED + "SELECT record_id, note FROM warned",
    )
)
def quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    return review.quality_warnings(decided_flags(spark, d)).select("record_id", "note")


_LOG = """event_type AS format, concat('export_', event_id, '.csv') AS file_name, props AS size, 'Admin' AS role,
    CAST(floor(value) AS BIGINT) AS records, CAST(ts AS {text}) AS timestamp"""


@plan(
    f"""SELECT {_LOG.format(text="VARCHAR")}, true AS logged FROM events""".replace("CAST(ts AS VARCHAR)", "strftime(ts, '%Y-%m-%d %H:%M:%S')")
)
def export_log(spark: SparkSession, d: str) -> DataFrame:
    """Export events appended to the log and read back."""
    path = scratch(spark, "export-log")
    events = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "event_type AS format", "concat('export_', event_id, '.csv') AS file_name", "props AS size",
        "'Admin' AS role", "CAST(floor(value) AS BIGINT) AS records",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp",
    )
    exports.log(events, path)
    return spark.read.parquet(path).withColumn("logged", F.col("created_at").isNotNull()).drop("created_at")


@plan(
    s.sql(
        DECIDED,
        f"""SELECT n_name AS company_id, {s.n_if("serious")} AS open_high, {s.n_if("serious")} = 0 AS available,
        CASE WHEN {s.n_if("serious")} > 0 THEN concat({s.n_if("serious")}, ' High-severity NPI error',
            CASE WHEN {s.n_if("serious")} > 1 THEN 's' ELSE '' END,
            ' must be resolved in Data Review before export.') END AS block_reason
        FROM nation LEFT JOIN (SELECT *, lower(category) = 'npi_validation' AND severity = 'High' AND NOT resolved AS serious
            FROM decided WHERE company_id <> 'CHINA') ON company_id = n_name GROUP BY 1""",
    )
)
def export_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate of every tenant; one of them has no flags."""
    flags = decided_flags(spark, d).where("company_id <> 'CHINA'")
    return exports.gate(flags, ["company_id"], table(spark, d, "nation").select(F.col("n_name").alias("company_id")))


@plan(
    s.sql("audit", f"SELECT event_id, ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOURS AS expired FROM audit")
)
def expired_exports(spark: SparkSession, d: str) -> DataFrame:
    history = s.audit(spark, d).withColumnRenamed("ts", "created_at")
    return search.with_expiry(history, EVENTS_AS_OF).select("event_id", "expired")


@plan(s.sql("audit", "SELECT event_id, actor, resource FROM audit ORDER BY ts DESC, event_id DESC"))
def export_history(spark: SparkSession, d: str) -> DataFrame:
    return search.newest(s.audit(spark, d), "ts", "event_id").select("event_id", "actor", "resource")
