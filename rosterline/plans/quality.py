"""Queries: cell states, heatmap, field and record health, record questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import text as t
from rosterline.operators import quality, search, summary
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.plans.inference import NORMAL, SQL_CHECKS
from rosterline.runtime import table

# Field, column, validity of a normalised value x, and the length below which it is only partial.
_RULES = [
    ("NPI", "npi", SQL_CHECKS["npi"], 1),
    ("First Name", "first_name", SQL_CHECKS["firstName"], 3),
    ("Last Name", "last_name", SQL_CHECKS["firstName"], 3),
    ("Specialty", "specialty", SQL_CHECKS["specialty"], 4),
    ("State", "state", SQL_CHECKS["practiceState"], 1),
    ("Email", "email", SQL_CHECKS["email"], 1),
    ("Phone", "phone", SQL_CHECKS["phone"], 1),
    ("ZIP Code", "zip", "regexp_matches(x, '^[0-9]{3,5}(-[0-9]{4})?$')", 5),
    ("DEA #", "dea", "regexp_matches(x, '^[A-Z]{2}[0-9]{7}$')", 1),
    ("Address", "address", "true", 10),
]

_CELLS = ", cells AS (" + " UNION ALL ".join(
    f"SELECT record_id, {i} AS ordinal, '{field}' AS field, CASE WHEN x = '' THEN 'missing' WHEN NOT {valid} THEN 'invalid' "
    f"WHEN length(x) < {full} THEN 'partial' ELSE 'complete' END AS status "
    f"FROM (SELECT record_id, {NORMAL.format(c=column)} AS x FROM records)"
    for i, (field, column, valid, full) in enumerate(_RULES)
) + ") "


@plan(s.sql("records", _CELLS + "SELECT record_id, string_agg(status, ',' ORDER BY ordinal) AS cells FROM cells GROUP BY 1"))
def cell_states(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.cells(s.records(spark, d))
    return judged.select("record_id", F.array_join(F.transform("cells", lambda c: c["status"]), ",").alias("cells"))


@plan(s.sql("records", _CELLS + "SELECT record_id FROM cells WHERE field IN ('Email', 'Phone') AND status = 'invalid' GROUP BY 1"))
def heatmap_filter(spark: SparkSession, d: str) -> DataFrame:
    shown = quality.cells(s.records(spark, d), fields=["Email", "Phone"], status="invalid")
    return shown.select("record_id")


@plan(
    s.sql(
        "records",
        _CELLS
        + f"""SELECT record_id, CAST(floor({s.n_if("status = 'complete'")} / 10 * 100 + 0.5) AS BIGINT) AS health
        FROM cells GROUP BY 1""",
    )
)
def record_health(spark: SparkSession, d: str) -> DataFrame:
    return quality.record_health(s.records(spark, d)).select("record_id", "health")


@plan(
    s.sql(
        "records",
        _CELLS
        + "SELECT field, count(*) AS records, "
        + ", ".join(f"{s.n_if(f'status = {chr(39)}{x}{chr(39)}')} AS {x}" for x in quality.STATES)
        + f""", round({s.n_if("status = 'missing'")} * 100.0 / count(*), 4) AS null_pct,
        round({s.n_if("status = 'complete'")} * 100.0 / count(*), 4) AS complete_pct,
        CASE WHEN {s.n_if("status = 'complete'")} * 100.0 / count(*) >= 90 THEN 'success'
             WHEN {s.n_if("status = 'complete'")} * 100.0 / count(*) >= 70 THEN 'warning' ELSE 'danger' END AS band
        FROM cells GROUP BY 1""",
    )
)
def field_health(spark: SparkSession, d: str) -> DataFrame:
    health = quality.field_health(s.records(spark, d))
    return health.select(
        "field", "records", *quality.STATES,
        F.round("null_pct", 4).alias("null_pct"), F.round("complete_pct", 4).alias("complete_pct"), "band",
    )


_NULL_FIELDS = ["email", "phone", "specialty", "dea", "address"]


@plan(
    s.sql(
        "records",
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, round(pct, 4) AS null_pct, round(100 - pct, 4) AS completeness, "
            f"CASE WHEN pct = 0 THEN 'success' WHEN pct <= 5 THEN 'warning' ELSE 'danger' END AS band FROM "
            f"(SELECT {s.n_if(NORMAL.format(c=c) + chr(61) + chr(39) * 2)} * 100.0 / count(*) AS pct FROM records)"
            for c in _NULL_FIELDS
        ),
    )
)
def null_summary(spark: SparkSession, d: str) -> DataFrame:
    found = quality.null_summary(s.records(spark, d), _NULL_FIELDS)
    return found.select(
        "field", F.round("null_pct", 4).alias("null_pct"), F.round("completeness", 4).alias("completeness"), "band"
    )


@plan(s.sql("records", "SELECT record_id, npi, state FROM records WHERE specialty = 'Machinery' AND state = 'AC'"))
def record_search(spark: SparkSession, d: str) -> DataFrame:
    return search.matching(s.records(spark, d), specialty="Machinery", state="AC").select("record_id", "npi", "state")


@plan(s.sql("records", "SELECT count(*) AS n FROM records WHERE specialty = 'Furniture' AND state = 'AB'"))
def record_count(spark: SparkSession, d: str) -> DataFrame:
    return search.how_many(s.records(spark, d), specialty="Furniture", state="AB")


@plan(
    s.sql(
        "records",
        f"""SELECT record_id, email FROM (SELECT record_id, email, {NORMAL.format(c="email")} AS x FROM records)
        WHERE x <> '' AND NOT {SQL_CHECKS["email"]}""",
    )
)
def invalid_emails(spark: SparkSession, d: str) -> DataFrame:
    return search.invalid_emails(s.records(spark, d)).select("record_id", "email")


@plan(
    s.sql("records", f"SELECT record_id FROM records WHERE updated_at >= TIMESTAMP '{s.AS_OF}' - INTERVAL 30 DAYS")
)
def recently_updated(spark: SparkSession, d: str) -> DataFrame:
    return search.since(s.records(spark, d), "updated_at", s.AS_OF, 30).select("record_id")


@plan(
    s.sql(
        "records",
        """, counted AS (SELECT specialty, count(*) AS n FROM records GROUP BY 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, specialty) AS r FROM counted)
        SELECT CASE WHEN r <= 4 THEN specialty ELSE 'Other' END AS name, CAST(sum(n) AS BIGINT) AS n,
        round(sum(n) * 100.0 / (SELECT count(*) FROM records), 4) AS pct FROM ranked GROUP BY 1""",
    )
)
def specialty_shares(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_shares(s.records(spark, d), "specialty").withColumn("pct", F.round("pct", 4))


@plan(s.sql("records", "SELECT specialty, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, specialty LIMIT 1"))
def top_specialty(spark: SparkSession, d: str) -> DataFrame:
    return summary.most_frequent(s.records(spark, d), "specialty")


@plan(
    s.sql(
        "records",
        """SELECT state, n, CAST(floor(n * 100.0 / (SELECT max(n) FROM (SELECT count(*) AS n FROM records GROUP BY state))
        + 0.5) AS BIGINT) AS density FROM (SELECT state, count(*) AS n FROM records GROUP BY 1)""",
    )
)
def state_density(spark: SparkSession, d: str) -> DataFrame:
    return summary.density(s.records(spark, d), "state")


@plan(
    """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x{a0}]+'), lambda w: w <> '')) AS words
    FROM documents"""
)
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.word_count(F.col("text")).alias("words"))


@plan(
    """SELECT page_id, CASE WHEN length(url) > 40 THEN left(url, 40) || '…' ELSE url END AS short_url,
        list_extract(string_split(url, '/'), -1) AS base,
        CASE WHEN contains(url, 'x=y.') THEN '' ELSE lower(regexp_extract(url, '\\.([^.]*)$', 1)) END AS extension,
        coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), url) AS anchor_or_url,
        concat('HCP_Clean_', regexp_replace(list_extract(string_split(url, '/'), -1), '\\..+$', ''), '_2026-07-18.csv')
            AS clean_name
    FROM pages"""
)
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        t.truncated(url, 40).alias("short_url"),
        t.base_name(url).alias("base"),
        t.extension(url).alias("extension"),
        t.first_filled(F.regexp_extract(url, "#(.*)$", 1), url).alias("anchor_or_url"),
        t.clean_list_file_name(t.base_name(url), F.lit("2026-07-18").cast("date")).alias("clean_name"),
    )


@plan(
    """SELECT c_custkey, concat(left(c_mktsegment, 1), left(p_name, 1), substr(p_name, strpos(p_name, ' ') + 1, 1))
        AS initials, format('{:,.2f}', c_acctbal) AS balance,
        try_cast(CASE WHEN c_acctbal < 0 THEN 'bad' ELSE '2026-07-18T10:00:00' END AS TIMESTAMP) IS NOT NULL AS readable
    FROM customer JOIN part ON c_custkey = p_partkey"""
)
def name_and_number_formats(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "part"), F.expr("c_custkey = p_partkey"))
    stamp = F.when(F.col("c_acctbal") < 0, "bad").otherwise("2026-07-18T10:00:00Z")
    return joined.select(
        "c_custkey",
        t.initials(F.concat_ws(" ", "c_mktsegment", "p_name")).alias("initials"),
        F.format_number("c_acctbal", 2).alias("balance"),
        t.instant(stamp).isNotNull().alias("readable"),
    )
