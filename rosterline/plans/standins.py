"""Provider-list roles played by the given tables, in Spark and in the SQL used to check it.

The given tables hold no provider lists, so each role is a projection of them: an order is a list row
about the customer who placed it, a nation is a tenant, a line item is a review decision. Gaps and
malformed cells follow from the values of other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.runtime import table

AS_OF = "2001-08-01 00:00:00"

_RECORD_COLUMNS = """
    n_name AS company_id,
    concat('upload_', CAST(year(o_orderdate) AS {text})) AS source,
    o_orderkey AS record_id,
    CASE WHEN o_totalprice < 20000 THEN CAST(c_custkey AS {text})
         ELSE CAST(1000000000 + c_custkey AS {text}) END AS npi,
    CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL
         ELSE concat(substr(o_orderpriority, 3, 1), lower(substr(o_orderpriority, 4))) END AS first_name,
    translate(c_name, '0123456789#', 'abcdefghij-') AS last_name,
    CASE WHEN o_orderstatus = 'O' AND c_acctbal < 0 THEN ' '
         ELSE concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) END AS specialty,
    CASE WHEN c_acctbal < 0 THEN lower(concat('A', chr(65 + n_nationkey)))
         ELSE concat('A', chr(65 + n_nationkey)) END AS state,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
         WHEN o_totalprice < 40000 THEN concat(lower(translate(c_name, '0123456789#', 'abcdefghij-')), ' at clinic')
         WHEN o_totalprice < 60000 THEN concat(lower(translate(c_name, '0123456789#', 'abcdefghij-')), '@mail.example')
         ELSE concat(lower(translate(c_name, '0123456789#', 'abcdefghij-')), '@',
                     replace(lower(n_name), '_', '-'), '.org') END AS email,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN NULL
         WHEN o_orderstatus = 'F' THEN concat('(', substr(digits, 1, 3), ') ', substr(digits, 4, 3), '-', substr(digits, 7, 4))
         WHEN o_orderstatus = 'O' THEN concat('+1-', substr(digits, 1, 3), '-', substr(digits, 4, 3), '-', substr(digits, 7, 4))
         ELSE digits END AS phone,
    CASE WHEN o_totalprice < 10000 THEN substr(digits, 5, 4) ELSE substr(digits, 4, 5) END AS zip,
    CASE WHEN o_orderstatus = 'P' THEN NULL
         ELSE concat(substr(c_mktsegment, 1, 2), substr(digits, 4, 7)) END AS dea,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN ''
         WHEN o_totalprice > 480000 THEN 'PO Box 7'
         ELSE concat(n_name, ' Street ', CAST(c_custkey AS {text})) END AS address,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS has_opted_in,
    CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'opt-out' ELSE '' END AS consent,
    o_totalprice AS volume,
    o_orderdate AS updated_at
"""

_FLAG_COLUMNS = """
    o_orderkey AS flag_id, n_name AS company_id, o_orderkey AS record_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'npi_validation' WHEN '2-HIGH' THEN 'PII'
         WHEN '3-MEDIUM' THEN 'duplicates' WHEN '4-NOT SPECIFIED' THEN 'Outliers' ELSE 'billing' END AS category,
    CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS severity,
    CASE o_orderstatus WHEN 'F' THEN 'email' WHEN 'O' THEN 'phone' ELSE 'address' END AS field,
    o_totalprice AS score
"""

_RESOLUTION_COLUMNS = """
    l_orderkey AS flag_id, l_shipdate AS ts, l_linenumber AS seq,
    CASE WHEN l_quantity > 45 THEN 'undo' WHEN l_quantity > 38 THEN 'override'
         WHEN l_discount > 0.07 THEN 'anonymized'
         WHEN l_returnflag = 'A' THEN 'removed' WHEN l_returnflag = 'N' THEN 'warned' ELSE 'merged' END AS action,
    CASE WHEN l_tax > 0.04 THEN 'verified with the practice' ELSE 'ok' END AS justification,
    CASE WHEN l_tax < 0.02 THEN NULL ELSE concat('note ', CAST(l_linenumber AS {text})) END AS note,
    CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END AS master
"""

_REGISTRY_COLUMNS = """
    CAST(1000000000 + c_custkey AS {text}) AS npi,
    CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
    CASE WHEN c_acctbal > 9000 THEN 'General Practice'
         ELSE concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) END AS specialty,
    CASE WHEN c_acctbal < 0 THEN 2019 END AS deactivated_year
"""

_COMPANY_COLUMNS = """
    n_name AS company_id, n_name AS name,
    concat(replace(lower(n_name), '_', '-'), '.org') AS email_domain,
    CASE r_name WHEN 'AFRICA' THEN 'suspended' WHEN 'ASIA' THEN 'trial' ELSE 'active' END AS status,
    CASE r_name WHEN 'AFRICA' THEN 'Starter' WHEN 'ASIA' THEN 'Pro' ELSE 'Enterprise' END AS plan
"""

# A part is one column of an upload; brand and name together stand for the upload.
_MAPPING_COLUMNS = """
    concat(p_brand, '/', p_name) AS upload_id, CAST(p_partkey AS {text}) AS raw,
    CASE p_type WHEN 'ECONOMY' THEN 'NPI' WHEN 'SMALL' THEN 'First Name' WHEN 'LARGE' THEN 'Last Name'
         WHEN 'MEDIUM' THEN 'Email' ELSE 'Ignore' END AS suggested,
    p_size / 50.0 AS confidence,
    CASE WHEN p_retailprice > 990 THEN 'Notes' WHEN p_retailprice > 960 THEN 'Ignore' END AS chosen
"""


def _spark(columns: str) -> str:
    return columns.format(text="STRING").replace("chr(", "char(")


def _duck(columns: str) -> str:
    return columns.format(text="VARCHAR")


def _project(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {_spark(columns)} FROM {{source}}", source=df)


def orders_of_nations(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey"))


def records(spark: SparkSession, d: str) -> DataFrame:
    digits = "lpad(CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS STRING), 10, '5') AS digits"
    return _project(orders_of_nations(spark, d).selectExpr("*", digits), _RECORD_COLUMNS)


def flags(spark: SparkSession, d: str) -> DataFrame:
    return _project(orders_of_nations(spark, d), _FLAG_COLUMNS)


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    return _project(table(spark, d, "lineitem"), _RESOLUTION_COLUMNS)


def registry(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("NOT c_acctbal BETWEEN 0 AND 500")
    return _project(known, _REGISTRY_COLUMNS)


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Tenants that exist; those of one region have children but no company row."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    joined = nation.join(region, F.expr("n_regionkey = r_regionkey")).where("r_name <> 'EUROPE'")
    return _project(joined, _COMPANY_COLUMNS)


def uploads(spark: SparkSession, d: str) -> DataFrame:
    per_order = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.avg("l_discount").alias("defects"))
    )
    return (
        orders_of_nations(spark, d)
        .join(per_order, "o_orderkey", "left")
        .selectExpr(
            "n_name AS company_id",
            "o_orderkey AS upload_id",
            "total_rows",
            "CASE WHEN o_orderstatus <> 'P' THEN 100 * (1 - 4 * defects) END AS health_score",
            "o_orderdate AS created_at",
        )
    )


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "ts", "concat('user ', CAST(user_id AS STRING)) AS actor", "event_type AS type",
        "props AS resource", "value",
    )


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return _project(table(spark, d, "part"), _MAPPING_COLUMNS)


def consent_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with consent from their quality label; unlabelled ones have none."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return documents.join(labels, "doc_id", "left").selectExpr(
        "doc_id", "text", "lang", "source", "n_chars", "CAST(quality = 1 AS BOOLEAN) AS has_opted_in"
    )


def providers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their region and order volume."""
    per_customer = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("o_totalprice").alias("volume"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
        .join(per_customer, "c_custkey", "left")
        .selectExpr(
            "c_custkey AS provider_id", "c_mktsegment AS specialty", "r_name AS region",
            "coalesce(volume, 0.0) AS volume", "coalesce(orders, 0) AS orders",
        )
    )


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _latest(log: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY flag_id ORDER BY ts DESC,
        seq DESC, action DESC, justification DESC, note DESC NULLS LAST, master DESC) AS rn
        FROM {log}) WHERE rn = 1 AND action <> 'undo'"""


SQL = {
    "records": f"""SELECT {_duck(_RECORD_COLUMNS)} FROM (SELECT *,
        lpad(CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR), 10, '5') AS digits FROM {_ORDERS})""",
    "flags": f"SELECT {_duck(_FLAG_COLUMNS)} FROM {_ORDERS}",
    "resolutions": f"SELECT {_duck(_RESOLUTION_COLUMNS)} FROM lineitem",
    "latest": _latest("resolutions"),
    "accepted": """SELECT resolutions.* FROM resolutions JOIN flags ON resolutions.flag_id = flags.flag_id
        WHERE action <> 'override' OR category <> 'npi_validation' OR length(justification) >= 15""",
    "effective": _latest("accepted"),
    "decided": """SELECT flags.*, action, note, justification, master, action IS NOT NULL AS resolved
        FROM flags LEFT JOIN effective USING (flag_id)""",
    "registry": f"SELECT {_duck(_REGISTRY_COLUMNS)} FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 500",
    "companies": f"""SELECT {_duck(_COMPANY_COLUMNS)} FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name <> 'EUROPE'""",
    "uploads": f"""SELECT n_name AS company_id, o_orderkey AS upload_id, total_rows,
        CASE WHEN o_orderstatus <> 'P' THEN 100 * (1 - 4 * defects) END AS health_score, o_orderdate AS created_at
        FROM {_ORDERS} LEFT JOIN (SELECT l_orderkey, count(*) AS total_rows, avg(l_discount) AS defects
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "audit": """SELECT event_id, ts, concat('user ', CAST(user_id AS VARCHAR)) AS actor, event_type AS type,
        props AS resource, value FROM events""",
    "mapping": f"SELECT {_duck(_MAPPING_COLUMNS)} FROM part",
    "resolved_mapping": """SELECT upload_id, raw, suggested, confidence, coalesce(chosen, suggested) AS target,
        coalesce(chosen, suggested) <> suggested AS overridden FROM mapping""",
    "consent_documents": """SELECT doc_id, text, lang, source, n_chars, quality = 1 AS has_opted_in
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "providers": """SELECT c_custkey AS provider_id, c_mktsegment AS specialty, r_name AS region,
        coalesce(volume, 0.0) AS volume, coalesce(orders, 0) AS orders
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS volume, count(*) AS orders FROM orders GROUP BY 1)
        ON o_custkey = c_custkey""",
}


def sql(names: str, body: str) -> str:
    """``body`` behind the named stand-ins."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body


def n_if(condition: str) -> str:
    """Number of rows that meet a condition, as a 64-bit integer."""
    return f"count(*) FILTER (WHERE {condition})"
