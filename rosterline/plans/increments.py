"""Queries: state that grows by uploads and batches, the release path, and the reports that follow a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.operators import flags, inference, linkage, quality, registry, score, search, summary
from rosterline.plans import detection, reports, review  # noqa: F401
from rosterline.plans import standins as s
from rosterline.plans.catalog import CHECKS, plan
from rosterline.plans.inference import COLUMNS
from rosterline.plans.release import _CSV_CELL, DECIDED, decided_flags
from rosterline.runtime import scratch, table
from rosterline.sources import exports, tenants

# Records come in this many uploads, by their number.
UPLOADS = 3


# --- state --------------------------------------------------------------------------------------

_CHANGES = """SELECT n_name AS company_id, o_custkey AS id, o_orderdate AS updated, o_orderkey AS seq, o_orderstatus AS status,
    o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_START = """SELECT n_name AS company_id, c_custkey AS id, TIMESTAMP '1970-01-01 00:00:00' AS updated, -1 AS seq,
    'pending' AS status, c_acctbal AS total FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@plan(
    f"""WITH every AS ({_START} UNION ALL {_CHANGES} WHERE n_nationkey < 10 AND o_orderkey % 2 = 0
        UNION ALL {_CHANGES} WHERE n_nationkey BETWEEN 5 AND 14)
    SELECT company_id, id, status, total, CAST(updated AS VARCHAR) AS updated FROM (SELECT *,
        row_number() OVER (PARTITION BY company_id, id ORDER BY updated DESC, seq DESC) AS rn FROM every) WHERE rn = 1"""
)
def merged_tenant_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers of all tenants, stored, after two batches of orders of some tenants each; the second arrives twice."""
    path = scratch(spark, "tenants")
    orders = s.orders_of_nations(spark, d)
    shape = ["n_name AS company_id", "c_custkey AS id", "o_orderdate AS updated", "o_orderkey AS seq", "o_orderstatus AS status", "o_totalprice AS total"]
    start = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr(
        "n_name AS company_id", "c_custkey AS id", "TIMESTAMP_NTZ '1970-01-01 00:00:00' AS updated", "-1L AS seq", "'pending' AS status", "c_acctbal AS total"
    )
    tenants.create(start, path)
    tenants.merge(orders.where("n_nationkey < 10 AND o_orderkey % 2 = 0").selectExpr(*shape), path, ["id"], ["updated", "seq"], "first")
    for _ in range(2):
        tenants.merge(orders.where("n_nationkey BETWEEN 5 AND 14").selectExpr(*shape), path, ["id"], ["updated", "seq"], "second")
    return tenants.stored(spark, path).select("company_id", "id", "status", "total", F.col("updated").cast("string").alias("updated"))


@plan(CHECKS["health_score_by_company"])
def health_score_from_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the stored sums of three uploads, one of them stored before and again after its review."""
    path = scratch(spark, "summaries")
    records, decided = s.records(spark, d), decided_flags(spark, d)
    undecided = s.flags(spark, d).withColumn("resolved", F.lit(False))
    part = F.col("record_id") % UPLOADS
    summary.store(summary.partials(records.where(part == 1), undecided.where(part == 1)), path, "1")
    for i in range(UPLOADS):
        summary.store(summary.partials(records.where(part == i), decided.where(part == i)), path, str(i))
    return score.from_sums(summary.combined(spark, path), ["company_id"])


@plan(
    s.sql(
        DECIDED + " records",
        "SELECT company_id, total_rows, "
        + ", ".join(f"coalesce({c}, 0) AS {c}_open" for c in summary.CATEGORIES)
        + " FROM (SELECT company_id, count(*) AS total_rows FROM records GROUP BY 1) LEFT JOIN (SELECT company_id, "
        + ", ".join(f"{s.n_if(f'lower(category) = {chr(39)}{c}{chr(39)} AND NOT resolved')} AS {c}" for c in summary.CATEGORIES)
        + " FROM decided GROUP BY 1) USING (company_id)",
    )
)
def dashboard_from_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Rows and open flags of every tenant from the stored sums of three uploads."""
    path = scratch(spark, "summaries")
    records, decided = s.records(spark, d), decided_flags(spark, d)
    part = F.col("record_id") % UPLOADS
    for i in range(UPLOADS):
        summary.store(summary.partials(records.where(part == i), decided.where(part == i)), path, str(i))
    return summary.combined(spark, path).select("company_id", "total_rows", *[f"{c}_open" for c in summary.CATEGORIES])


@plan(CHECKS["column_types"])
def column_types_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Types of a list in three files from the stored counts of each; one file has its columns in another order."""
    path = scratch(spark, "type-counts")
    records = s.records(spark, d)
    for i in range(UPLOADS):
        columns = COLUMNS if i < 2 else COLUMNS[::-1]
        counts = inference.value_counts(records.where(F.col("record_id") % UPLOADS == i), columns)
        place = F.array_position(F.array(*map(F.lit, COLUMNS)), F.col("column")).cast("int") - 1
        counts.withColumn("ordinal", place).write.mode("overwrite").parquet(f"{path}/file={i}")
    types = inference.decide(inference.merge_counts(spark.read.parquet(path)))
    return types.select("ordinal", "column", "non_empty", F.round("best_share", 4).alias("best_share"), "inferred_type")


@plan(
    """SELECT event_type AS format, concat('export_', event_id, '.csv') AS file_name, CAST(floor(value) AS BIGINT) AS records FROM events"""
)
def export_log_of_batches(spark: SparkSession, d: str) -> DataFrame:
    """Export events logged by two jobs, one of which ran twice."""
    path = scratch(spark, "export-log")
    events = table(spark, d, "events").selectExpr(
        "event_type AS format", "concat('export_', event_id, '.csv') AS file_name", "CAST(floor(value) AS BIGINT) AS records", "event_id % 2 AS job"
    )
    for job in (0, 1, 1):
        exports.log(events.where(F.col("job") == job).drop("job"), path, f"job-{job}")
    return spark.read.parquet(path).select("format", "file_name", "records")


# --- neighbours ---------------------------------------------------------------------------------


@plan(
    s.sql(
        "records",
        """, placed AS (SELECT state, record_id, row_number() OVER (PARTITION BY state
            ORDER BY trim(coalesce(last_name, '')), trim(coalesce(first_name, '')), record_id) AS at FROM records)
        SELECT a.state AS block, a.record_id AS rec1, b.record_id AS rec2 FROM placed a JOIN placed b
            ON a.state = b.state AND b.at BETWEEN a.at + 1 AND a.at + 2""",
    )
)
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Records of a state that follow each other by name, as candidates besides those with the same number."""
    return linkage.neighbour_pairs(s.records(spark, d), block="state", fields=("npi",)).select("block", "rec1", "rec2")


# --- release and reports ------------------------------------------------------------------------

_WITHDRAWN = "lower(category) = 'npi_validation' AND severity = 'High' AND NOT resolved AND ascii(right(company_id, 1)) % 2 = 0"


def _second_review(spark: SparkSession, d: str) -> DataFrame:
    """Decided flags after a second review, which withdrew the open number errors of some tenants."""
    return detection._reviewed(spark, d).where(f"NOT ({_WITHDRAWN})")


_CLEAN = [*exports.CLEAN_COLUMNS][1:]


@plan(
    detection._review_sql(
        detection._LEAVING
        + f""", closed AS (SELECT company_id FROM decided WHERE NOT ({_WITHDRAWN})
            AND lower(category) = 'npi_validation' AND severity = 'High' AND NOT resolved),
        list AS (SELECT * REPLACE (CASE WHEN masked.record_id IS NULL THEN email ELSE sha256(email) END AS email),
                CASE WHEN note IS NULL THEN '' ELSE '[DATA QUALITY WARNING]' END AS dq_flag
            FROM records LEFT JOIN masked USING (record_id) LEFT JOIN warned USING (record_id)
            WHERE record_id NOT IN (SELECT record_id FROM losers) AND company_id NOT IN (SELECT company_id FROM closed))
        SELECT company_id, 0 AS section, '{",".join(exports.CLEAN_COLUMNS.values())}' AS line FROM list GROUP BY 1
        UNION ALL SELECT company_id, 1, concat_ws(',', dq_flag, {", ".join(_CSV_CELL.format(c=f"coalesce({c}, '')") for c in _CLEAN)}) FROM list
        UNION ALL SELECT company_id, 2, concat('# ', format('{{:,}}', count(*)), ' total records · ', {s.n_if("dq_flag <> ''")},
            ' DQ warnings · Role: Admin') FROM list GROUP BY 1"""
    )
)
def released_clean_list(spark: SparkSession, d: str) -> DataFrame:
    """The clean lists of the tenants whose gate is open, as lines with header and trailer, after all decisions."""
    decided = _second_review(spark, d)
    records = flags.cleared(s.records(spark, d), decided).select("company_id", "record_id", *_CLEAN)
    pairs = linkage.duplicate_pairs(s.records(spark, d), fields=("npi",))
    return exports.clean_lines(flags.release(records, decided, pairs, ["email"]), "Admin")


@plan(
    detection._review_sql(
        """ SELECT record_id, concat_ws(' ', first_name, last_name) AS name, specialty, score, reason, note FROM records
        JOIN (SELECT record_id, score, reason, note FROM decided WHERE action = 'warned') USING (record_id)"""
    )
)
def warned_records(spark: SparkSession, d: str) -> DataFrame:
    return summary.warned_records(s.records(spark, d), detection._reviewed(spark, d))


@plan(
    f"""SELECT report.*, CAST(score AS BIGINT) AS quality_score FROM ({CHECKS["audit_report"]}) AS report, ({CHECKS["health_score"]})"""
)
def audit_report_with_score(spark: SparkSession, d: str) -> DataFrame:
    decided = decided_flags(spark, d)
    sizes = s.records(spark, d).agg(F.count(F.lit(1)).alias("total_rows"))
    points = score.health_score(decided, sizes).select("score").scalar()
    return summary.audit_report(decided, sizes.scalar(), points)


@plan(
    s.sql(
        "records registry",
        """SELECT record_id, r.npi, r.specialty FROM records r JOIN registry g ON g.npi = r.npi
        WHERE r.specialty = 'Machinery' AND state = 'AC' AND status = 'Active'""",
    )
)
def active_record_search(spark: SparkSession, d: str) -> DataFrame:
    """A record question that also asks for the status in the registry; the record filters come before the join."""
    asked = search.matching(s.records(spark, d), specialty="Machinery", state="AC")
    found = registry.validate(asked, s.registry(spark, d))
    return search.matching(found, registry_status="Active").select("record_id", "npi", "specialty")


@plan("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat(coalesce(text, ''), chr(65533), '!') AS text, 'True' AS has_opted_in FROM documents""")
def scrubbed_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with an invalid byte, which leaves the export as a replacement character."""
    broken = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("!"), "UTF-8"))
    return exports.for_crm(table(spark, d, "documents").select("doc_id", broken.alias("text"), F.lit(True).alias("has_opted_in")))


# --- review lists by their other keys -----------------------------------------------------------

_BLANKS = ["first_name", "specialty", "email", "phone", "dea", "address"]
_PCT = " + ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 1 ELSE 0 END" for c in _BLANKS)


def _with_nulls(spark: SparkSession, d: str, category: str) -> DataFrame:
    shares = s.records(spark, d).select("record_id", quality.null_pct(_BLANKS).alias("null_pct"))
    return review._category(spark, d, category).join(shares, "record_id")


def _nulls_sql(category: str, key: str) -> str:
    return s.sql(
        "flags records",
        f"""SELECT flag_id, field, record_id, round(null_pct, 4) AS null_pct FROM flags
        JOIN (SELECT record_id, ({_PCT}) * 100.0 / {len(_BLANKS)} AS null_pct FROM records) USING (record_id)
        WHERE lower(category) = '{category}' ORDER BY {key}, flag_id""",
    )


def _list(spark: SparkSession, d: str, category: str, by: str, descending: bool) -> DataFrame:
    listed = search.ordered(_with_nulls(spark, d, category), by, "flag_id", descending)
    return listed.select("flag_id", "field", "record_id", F.round("null_pct", 4).alias("null_pct"))


@plan(_nulls_sql("pii", "null_pct DESC"))
def pii_list_by_null_share(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "pii", "null_pct", True)


@plan(_nulls_sql("pii", "field"))
def pii_list_by_field(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "pii", "field", False)


@plan(_nulls_sql("outliers", "record_id DESC"))
def outlier_list_by_record(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "outliers", "record_id", True)


@plan(s.sql("records registry", detection._CHECKED + " SELECT record_id, issue_type, npi FROM errors JOIN records USING (record_id) ORDER BY issue_type, record_id"))
def npi_list_by_issue(spark: SparkSession, d: str) -> DataFrame:
    found = registry.errors(registry.validate(s.records(spark, d), s.registry(spark, d)))
    return search.ordered(found, "issue_type", "record_id", descending=False).select("record_id", "issue_type", "npi")
