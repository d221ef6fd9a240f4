"""Queries: uploads, CSV files, tenants and column mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import text as t
from rosterline.functions.bands import upload_band
from rosterline.operators import mapping, search
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.plans.inference import COLUMNS, infer_sql
from rosterline.runtime import scratch, table
from rosterline.sources import csv_check, csv_rows, csv_scan, exports, tenants, upload
from rosterline.streaming import ingest


@plan(
    s.sql(
        "records",
        f"""SELECT (SELECT count(*) FROM records) AS total_rows, ordinal, "column", non_empty, inferred_type
        FROM ({infer_sql({c: c for c in COLUMNS}, "records")})""",
    )
)
def csv_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """Records written as CSV files, scanned back and reported."""
    path = scratch(spark, "upload")
    exports.write_csv(s.records(spark, d).select(*COLUMNS), path)
    return csv_scan.ingest_report(csv_scan.scan(spark, path))


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every document and page as one file of lines; some documents get a byte that isn't UTF-8 in their second line."""
    documents = table(spark, d, "documents").selectExpr("concat('documents/', doc_id) AS file", "text", "doc_id % 40 = 3 AS bad")
    pages = table(spark, d, "pages").selectExpr("concat('pages/', page_id) AS file", "html AS text", "false AS bad")
    split = documents.unionByName(pages).withColumn("text", F.split("text", "\n"))
    lines = split.select("file", (F.col("bad") & (F.least(F.size("text"), F.lit(2)) == 1)).alias("one"), "bad", F.posexplode("text").alias("pos", "line"))
    hit = F.col("bad") & (F.col("pos") == F.when(F.col("one"), 0).otherwise(1))
    broken = F.concat(F.col("line").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    lines = lines.withColumn("line", F.when(hit, broken).otherwise(F.col("line")))
    return lines.select("file", F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "line")


# The check walks the lines of each text one by one.
@plan(
    """WITH RECURSIVE files AS (
        SELECT concat('documents/', doc_id) AS file, string_split(text, chr(10)) AS lines, doc_id % 40 = 3 AS bad FROM documents
        UNION ALL SELECT concat('pages/', page_id), string_split(html, chr(10)), false FROM pages),
    whole AS (SELECT file, bad, len(lines) AS n, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM files),
    lines AS (SELECT file, i, line || CASE WHEN bad AND i = least(2, n) THEN '?' ELSE '' END AS line FROM whole),
    step AS (SELECT file, i, CASE
        WHEN regexp_matches(line, '^("[^"]*(""[^"]*)*"|[^",][^,]*|)(,("[^"]*(""[^"]*)*"|[^",][^,]*|))*$') THEN 0
        WHEN regexp_matches(line, '^(("[^"]*(""[^"]*)*"|[^",][^,]*|),)*"[^"]*(""[^"]*)*$') THEN 1 ELSE 2 END AS o, CASE
        WHEN regexp_matches(line, '^[^"]*(""[^"]*)*(",(("[^"]*(""[^"]*)*"|[^",][^,]*|),)*"[^"]*(""[^"]*)*)?$') THEN 1
        WHEN regexp_matches(line, '^[^"]*(""[^"]*)*"(,("[^"]*(""[^"]*)*"|[^",][^,]*|))*$') THEN 0 ELSE 2 END AS n
        FROM lines),
    walk AS (SELECT file, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(NULL AS BIGINT) AS bad, false AS multi FROM files
        UNION ALL SELECT walk.file, step.i,
            CASE state WHEN 0 THEN o WHEN 1 THEN n ELSE 2 END,
            CASE WHEN bad IS NULL AND (CASE state WHEN 0 THEN o WHEN 1 THEN n ELSE 2 END) = 2 THEN step.i ELSE bad END,
            multi OR (CASE state WHEN 0 THEN o WHEN 1 THEN n ELSE 2 END) = 1
        FROM walk JOIN step ON step.file = walk.file AND step.i = walk.i + 1)
    SELECT walk.file, len(files.lines) AS lines,
        CASE WHEN files.bad THEN 'invalid_utf8' WHEN state = 0 THEN 'ok' WHEN state = 1 THEN 'unclosed_quote' ELSE 'stray_text' END AS status,
        CASE WHEN files.bad THEN 1 WHEN state = 1 THEN len(files.lines) WHEN state = 2 THEN walk.bad ELSE 0 END AS line_number, multi AS multi_line,
        CASE WHEN files.bad THEN least(2, len(files.lines)) ELSE 0 END AS bad_line
    FROM walk JOIN files ON walk.file = files.file AND walk.i = len(files.lines)"""
)
def csv_structure(spark: SparkSession, d: str) -> DataFrame:
    verdicts = csv_check.structure_faults(_text_lines(spark, d), ())  # every text is one split
    return verdicts.drop("header", "header_pos").fillna(0, ["line_number", "bad_line"])


@plan(
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'error-type' WHEN n_chars * 40000 > 52428800 THEN 'error-size'
        ELSE 'accept' END AS verdict, concat(source, '.', CASE lang WHEN 'en' THEN 'csv' WHEN 'fr' THEN 'XLSX'
        WHEN 'de' THEN 'pdf' ELSE 'Csv' END) AS file_name FROM documents"""
)
def file_admission(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").selectExpr(
        "doc_id",
        """concat('in/', doc_id, '/', source, '.',
           CASE lang WHEN 'en' THEN 'csv' WHEN 'fr' THEN 'XLSX' WHEN 'de' THEN 'pdf' ELSE 'Csv' END) AS path""",
        "n_chars * 40000 AS length",
    )
    return csv_scan.admission(files).select("doc_id", "verdict", "file_name")


@plan(
    """WITH lists AS (SELECT n_name || '-' || c_custkey // 1000 AS folder, any_value(n_nationkey) AS k
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT folder, 'csv' AS extension, 'accept' AS verdict, k % 2 = 0 AS has_rows FROM lists
    UNION ALL SELECT folder, 'txt', 'error-type', true FROM lists WHERE k % 5 = 0"""
)
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Admission of one file per nation and thousand customers, and of another format for some; their contents are not read."""
    path = scratch(spark, "listing")
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    nations = customers.selectExpr("concat(n_name, '-', c_custkey div 1000) AS folder", "n_nationkey", "repeat(n_name, 20) AS value").distinct()
    for kind, some in (("csv", F.lit(True)), ("text", F.col("n_nationkey") % 5 == 0)):
        value = F.when((F.col("n_nationkey") % 2 == 0) | F.lit(kind == "text"), F.col("value")).otherwise("-")
        rows = nations.where(some).select("folder", value.alias("value"))
        # A number of tasks, or the few bytes are coalesced into one task that makes all the files; each task moves its own into place.
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")
        by_tasks = dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        by_tasks.partitionBy("folder").format(kind).save(path)
    found = csv_scan.admission(csv_scan.list_files(spark, path))
    folder = F.regexp_extract("path", "folder=([^/]+)/", 1)
    return found.select(folder.alias("folder"), t.extension(F.col("path")).alias("extension"), "verdict", (F.col("length") > 20).alias("has_rows"))


@plan(
    s.sql(
        "records",
        """, quoted AS (SELECT record_id, CASE WHEN has_opted_in THEN npi ELSE 'x' || npi END AS npi, phone,
            volume > 450000 AND address IS NOT NULL AS opened FROM records)
        SELECT record_id AS row, 'npi' AS col, 'Non-numeric characters in NPI field' AS detail FROM quoted
            WHERE NOT regexp_matches(npi, '^[0-9]+$')
        UNION ALL SELECT record_id, 'phone',
            'Field contains ' || length(phone) || ' characters — exceeds 14-char phone max'
            FROM quoted WHERE length(phone) > 14
        UNION ALL SELECT record_id, 'address', 'Unclosed quote in field value' FROM quoted WHERE opened""",
    )
)
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).selectExpr(
        "record_id",
        "CASE WHEN has_opted_in THEN npi ELSE concat('x', npi) END AS npi",
        "phone",
        "CASE WHEN volume > 450000 THEN concat('\"', address) WHEN volume > 400000 THEN concat('\"5\"\" ', address, '\"') "
        "ELSE address END AS address",
    )
    columns = ["record_id", "npi", "phone", "address"]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return csv_scan.parse_errors(rows.withColumn("line", line), "record_id", "npi", "phone", "line", columns)


@plan(s.sql("records", "SELECT record_id, npi, specialty FROM records WHERE company_id = 'NATION_7'"))
def tenant_records(spark: SparkSession, d: str) -> DataFrame:
    """One tenant of a table that is stored by tenant; other tenants' files are not read."""
    path = scratch(spark, "records")
    tenants.write_records(s.records(spark, d), path)
    return tenants.tenant(tenants.read_table(spark, path), "NATION_7").select("record_id", "npi", "specialty")


@plan(
    s.sql(
        "companies uploads",
        """SELECT company_id, count(*) AS uploads, CAST(coalesce(sum(total_rows), 0) AS BIGINT) AS total_rows
        FROM uploads WHERE company_id IN (SELECT company_id FROM companies) GROUP BY 1""",
    )
)
def uploads_of_companies(spark: SparkSession, d: str) -> DataFrame:
    found = tenants.of_companies(s.uploads(spark, d), s.companies(spark, d))
    return found.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("uploads"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows")
    )


@plan(
    """SELECT c_custkey AS id, status, total, CAST(updated AS VARCHAR) AS updated FROM (
        SELECT o_custkey AS c_custkey, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS updated,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        WHERE rn = 1
    UNION ALL SELECT c_custkey, 'pending', c_acctbal, '1970-01-01 00:00:00' FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def upserted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Customer documents overwritten by the latest of their orders."""
    start = table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "TIMESTAMP_NTZ '1970-01-01 00:00:00' AS updated", "-1L AS seq", "'pending' AS status",
        "c_acctbal AS total",
    )
    changes = table(spark, d, "orders").selectExpr(
        "o_custkey AS id", "o_orderdate AS updated", "o_orderkey AS seq", "o_orderstatus AS status",
        "o_totalprice AS total",
    )
    merged = tenants.upsert(start, changes, ["id"], ["updated", "seq"])
    return merged.select("id", "status", "total", F.col("updated").cast("string").alias("updated"))


_GUARDED = """CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE n_name END AS company_id,
    CASE WHEN o_orderstatus = 'P' THEN 'NATION_0' ELSE n_name END AS path_company, o_orderkey AS upload_id"""


@plan(
    f"""SELECT upload_id, CASE WHEN company_id IS NULL THEN 'company_id is required for tenant-scoped documents'
        WHEN company_id <> path_company THEN 'Payload company_id must match the path company_id'
        ELSE 'accepted' END AS reason
        FROM (SELECT {_GUARDED} FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey)"""
)
def tenant_guard(spark: SparkSession, d: str) -> DataFrame:
    payload = s.orders_of_nations(spark, d).selectExpr(
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE n_name END AS company_id",
        "CASE WHEN o_orderstatus = 'P' THEN 'NATION_0' ELSE n_name END AS path_company",
        "o_orderkey AS upload_id",
    )
    accepted, rejected = tenants.guard(payload, F.col("path_company"))
    return tenants.stack(accepted.withColumn("reason", F.lit("accepted")), rejected).select("upload_id", "reason")


@plan(s.sql("records", "SELECT record_id, npi, last_name FROM records ORDER BY record_id LIMIT 5"))
def upload_preview(spark: SparkSession, d: str) -> DataFrame:
    return csv_scan.preview(s.records(spark, d).select("record_id", "npi", "last_name"), ["record_id"])


@plan(
    """SELECT doc_id, concat('companies/', lang, '/uploads/', doc_id, '_', source, '.csv') AS storage_path
        FROM documents"""
)
def storage_paths(spark: SparkSession, d: str) -> DataFrame:
    upload = F.col("doc_id").cast("string")
    given = F.concat(F.lit("C:\\lists\\in/"), F.col("source"), F.lit(".csv"))
    path = csv_scan.storage_path(F.col("lang"), upload, given)
    return table(spark, d, "documents").select("doc_id", path.alias("storage_path"))


@plan(
    s.sql(
        "records",
        """SELECT record_id, npi, NULL AS email, state FROM records WHERE has_opted_in
        UNION ALL SELECT record_id, npi, email, NULL FROM records WHERE has_opted_in IS NULL
        UNION ALL SELECT record_id, npi, email, state FROM records WHERE NOT has_opted_in""",
    )
)
def stacked_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of three shapes in one frame."""
    r = s.records(spark, d)
    with_state = r.where("has_opted_in").select("record_id", "npi", "state")
    with_email = r.where("has_opted_in IS NULL").select("record_id", "npi", "email")
    return tenants.stack(with_state, with_email, r.where("NOT has_opted_in").select("state", "email", "npi", "record_id"))


def _resolved_mapping(spark: SparkSession, d: str) -> DataFrame:
    suggestions = s.mapping(spark, d)
    overrides = suggestions.where("chosen IS NOT NULL").selectExpr("upload_id", "raw", "chosen AS target")
    return mapping.resolve(suggestions.drop("chosen"), overrides, ["upload_id"])


@plan(s.sql("mapping resolved_mapping", """SELECT upload_id, raw, target, overridden, CASE WHEN confidence >= 0.90
    THEN 'High' WHEN confidence >= 0.75 THEN 'Medium' ELSE 'Low' END AS tier FROM resolved_mapping"""))
def column_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _resolved_mapping(spark, d).select("upload_id", "raw", "target", "overridden", "tier")


_DOUBLED = " UNION ALL ".join(
    f"SELECT upload_id FROM resolved_mapping WHERE target = '{t}' GROUP BY 1 HAVING count(*) > 1"
    for t in mapping.TARGETS
    if t != "Ignore"
)


@plan(
    s.sql(
        "mapping resolved_mapping",
        f""", doubled AS (SELECT upload_id, count(*) AS n FROM ({_DOUBLED}) GROUP BY 1),
        counted AS (SELECT upload_id, count(*) AS columns, {s.n_if("confidence >= 0.80")} AS pre_mapped,
            {s.n_if("overridden")} AS overridden,
            concat_ws(',', CASE WHEN {s.n_if("target = 'NPI'")} = 0 THEN 'NPI' END,
                CASE WHEN {s.n_if("target = 'First Name'")} = 0 THEN 'First Name' END,
                CASE WHEN {s.n_if("target = 'Last Name'")} = 0 THEN 'Last Name' END) AS missing_required
            FROM resolved_mapping GROUP BY 1)
        SELECT upload_id, columns, pre_mapped, overridden, missing_required, coalesce(n, 0) AS duplicated,
            missing_required = '' AND n IS NULL AS can_proceed FROM counted LEFT JOIN doubled USING (upload_id)""",
    )
)
def mapping_validation(spark: SparkSession, d: str) -> DataFrame:
    checked = mapping.report(_resolved_mapping(spark, d), ["upload_id"])
    return checked.withColumn("missing_required", F.array_join("missing_required", ",")).withColumn(
        "duplicated", F.size("duplicated").cast("long")
    )


@plan(
    s.sql(
        "mapping resolved_mapping",
        """SELECT upload_id, target FROM (SELECT DISTINCT upload_id FROM resolved_mapping),
        (VALUES ('NPI'), ('First Name'), ('Last Name')) AS required (target)
        EXCEPT SELECT upload_id, target FROM resolved_mapping""",
    )
)
def missing_required_columns(spark: SparkSession, d: str) -> DataFrame:
    return mapping.missing_required(_resolved_mapping(spark, d), ["upload_id"])


@plan("""SELECT p_partkey AS "NPI", p_name AS "First Name", p_brand AS "Last Name" FROM part""")
def mapped_columns(spark: SparkSession, d: str) -> DataFrame:
    chosen = {"p_partkey": "NPI", "p_name": "First Name", "p_brand": "Last Name", "p_type": "Ignore"}
    return mapping.apply(table(spark, d, "part"), chosen)


@plan(
    s.sql(
        "uploads",
        f"""SELECT upload_id, coalesce(total_rows, 0) AS total_rows FROM uploads
        WHERE created_at >= TIMESTAMP '{s.AS_OF}' - INTERVAL 7 DAYS""",
    )
)
def recent_uploads(spark: SparkSession, d: str) -> DataFrame:
    recent = search.since(s.uploads(spark, d), "created_at", s.AS_OF, 7)
    return recent.select("upload_id", F.coalesce("total_rows", F.lit(0)).alias("total_rows"))


@plan(
    s.sql(
        "uploads",
        f"""SELECT upload_id, company_id, CASE WHEN health_score >= 80 THEN 'success' WHEN health_score >= 65
        THEN 'warning' ELSE 'danger' END AS band FROM uploads
        WHERE created_at >= TIMESTAMP '{s.AS_OF}' - INTERVAL 90 DAYS""",
    )
)
def upload_history(spark: SparkSession, d: str) -> DataFrame:
    recent = search.since(s.uploads(spark, d), "created_at", s.AS_OF, 90)
    return recent.select("upload_id", "company_id", upload_band(F.col("health_score")).alias("band"))


@plan(s.sql("records", "SELECT source AS upload_id, count(*) AS total_rows FROM records GROUP BY 1"))
def streamed_row_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records arriving as CSV files, ingested as a stream with a running count per upload."""
    landing = scratch(spark, "landing")
    columns = ["record_id", "npi", "email", "source"]
    exports.write_csv(s.records(spark, d).select(*columns), landing)
    out, checkpoint = scratch(spark, "ingested"), scratch(spark, "ingest-state")
    query = ingest.start(ingest.csv_stream(spark, landing), columns, out, checkpoint, key="source")
    query.awaitTermination()
    return ingest.running_totals(spark, out, "source").withColumnRenamed("source", "upload_id")


# Layouts of the uploads below: plain, another header order with line ends in fields, rows of the wrong width, text behind a closing quote.
HEADERS = ("id,customer,note", "note,id,customer", "id,customer,note", "id,customer,note")
IDS_PER_FILE = 100_000


def _uploads(spark: SparkSession, d: str, path: str) -> None:
    """Orders as CSV files, a folder per tenant, layout and range of ids."""
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey") % 3).alias("company"),
        (F.col("o_orderkey") % 4).cast("int").alias("layout"),
        F.floor(F.col("o_orderkey") / IDS_PER_FILE).alias("part"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
    )
    key = F.concat_ws(",", "id", "customer")
    width = F.col("customer") % 5
    lines = (
        F.when(F.col("layout") == 0, F.array(F.concat(key, F.lit(',"5"" x"'))))
        .when(F.col("layout") == 1, F.array(F.lit('"line one'), F.concat(F.lit('line two",'), key)))
        .when(F.col("layout") == 3, F.array(F.concat(key, F.lit(',"open"text'))))
        .when(width == 0, F.array(F.concat(key, F.lit(',5" n,6" n'))))
        .when(width == 1, F.array(key))
        .otherwise(F.array(F.concat(key, F.lit(',6" y'))))
    )
    body = orders.select("company", "layout", "part", "id", F.posexplode(lines).alias("at", "line"))
    head = orders.select("company", "layout", "part").distinct().select(
        "*", F.lit(-1).cast("long").alias("id"), F.lit(0).alias("at"), F.element_at(F.array(*map(F.lit, HEADERS)), F.col("layout") + 1).alias("line")
    )
    group = ["company", "layout", "part"]
    files = head.unionByName(body).repartition(*group).sortWithinPartitions(*group, "id", "at")
    # separator and quote that no line holds, so that lines are written as they are
    raw = files.select(*group, "line").write.partitionBy(*group)
    raw.csv(path, sep="\u0001", quote="\u0002", escape="\u0003", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@plan(
    """WITH o AS (SELECT concat('T', o_custkey % 3) AS company, CAST(o_orderkey % 4 AS INT) AS layout, o_orderkey AS id,
        o_custkey % 5 AS w FROM orders),
    r AS (SELECT *, layout < 3 AND NOT (layout = 2 AND w = 0) AS kept,
        CASE layout WHEN 0 THEN 4 WHEN 1 THEN 17 WHEN 2 THEN CASE WHEN w > 1 THEN 4 END END AS chars FROM o)
    SELECT company, layout, layout = 3 AS rejected, count_if(kept) AS kept, count_if(layout = 2 AND w = 0) AS quarantined,
        count_if(kept AND layout = 2 AND w = 1) AS short, CAST(coalesce(sum(id) FILTER (kept), 0) AS BIGINT) AS id_sum,
        CAST(coalesce(sum(chars) FILTER (kept), 0) AS BIGINT) AS note_chars
    FROM r GROUP BY 1, 2"""
)
def upload_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Files of three tenants checked, read each by its own header and mode, with nothing lost."""
    path = scratch(spark, "uploads")
    _uploads(spark, d, path)
    found = upload.read(spark, path)

    def keys(file: str) -> list:
        company = F.regexp_extract(file, "company=([^/]*)", 1).alias("company")
        return [company, F.regexp_extract(file, "layout=([^/]*)", 1).cast("int").alias("layout")]

    rows = found.rows.groupBy(*keys(upload.FILE)).agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if("_short").alias("short"),
        F.sum(F.col("id").cast("long")).alias("id_sum"),
        F.sum(F.char_length("note")).cast("long").alias("note_chars"),
    )
    aside = found.quarantine.groupBy(*keys(upload.FILE)).agg(F.count(F.lit(1)).alias("quarantined"))
    files = found.verdicts.groupBy(*keys("file")).agg(F.bool_or(F.col("status") != "ok").alias("rejected"))
    joined = files.join(rows, ["company", "layout"], "left").join(aside, ["company", "layout"], "left")
    return joined.fillna(0, ["kept", "quarantined", "short", "id_sum", "note_chars"])


_FILES = f"""WITH o AS (SELECT concat('T', o_custkey % 3) AS company, CAST(o_orderkey % 4 AS INT) AS layout, o_orderkey // {IDS_PER_FILE} AS part,
    o_orderkey AS id, o_custkey AS customer, o_custkey % 5 AS w FROM orders),
    r AS (SELECT *, concat(company, '/', layout, '/', part) AS upload_id, layout = 2 AND w = 0 AS wide, layout = 2 AND w = 1 AS short FROM o)"""


def _scanned(spark: SparkSession, d: str) -> upload.Scan:
    path = scratch(spark, "uploads")
    _uploads(spark, d, path)
    return upload.scan(spark, path)


def _part(name: str, file: str = "file") -> Column:
    return F.regexp_extract(file, f"{name}=([^/]*)", 1)


def _upload_id(file: str = "file") -> Column:
    return F.concat_ws("/", _part("company", file), _part("layout", file), _part("part", file)).alias("upload_id")


@plan(
    _FILES
    + """SELECT company AS company_id, upload_id, CASE WHEN layout = 3 THEN 'stray_text' ELSE 'ok' END AS status,
        CASE WHEN layout = 3 THEN 2 ELSE 0 END AS line_number, CASE WHEN layout = 3 THEN 0 ELSE count_if(NOT wide) END AS total_rows,
        count_if(short) AS short_rows, count_if(wide) AS quarantined,
        CASE layout WHEN 3 THEN '' WHEN 1 THEN 'note,id,customer' ELSE 'id,customer,note' END AS columns
    FROM r GROUP BY company, upload_id, layout"""
)
def upload_rows(spark: SparkSession, d: str) -> DataFrame:
    """The list of uploads that the files of three tenants give."""
    listed = upload.uploads(_scanned(spark, d), _part("company"), _upload_id())
    return listed.drop("file_name", "storage_path").withColumn("columns", F.array_join("columns", ",")).fillna(0, ["line_number"])


@plan(
    _FILES
    + """SELECT upload_id, id::VARCHAR AS npi, CASE layout WHEN 0 THEN customer::VARCHAR WHEN 1 THEN 'line one' || chr(10) || 'line two' END AS last_name,
        CASE WHEN layout = 2 AND NOT short THEN '6" y' END AS notes, short FROM r WHERE layout < 3 AND NOT wide"""
)
def uploaded_records(spark: SparkSession, d: str) -> DataFrame:
    """All uploads as records under canonical names, each file by its own mapping."""
    found = _scanned(spark, d)
    pairs = (("id", "NPI", None), ("customer", "Last Name", "0"), ("note", "Last Name", "1"), ("note", "Notes", "2"))
    chosen = F.array(*[F.struct(F.lit(raw).alias("raw"), F.lit(to).alias("target"), F.lit(layout).alias("layout")) for raw, to, layout in pairs])
    each = found.files.select("file", F.inline(chosen)).where(F.col("layout").isNull() | (F.col("layout") == _part("layout")))
    records = upload.mapped(found, each, ["NPI", "Last Name", "Notes"])
    return records.select(_upload_id(), F.col("NPI").alias("npi"), F.col("Last Name").alias("last_name"), F.col("Notes").alias("notes"), F.col("_short").alias("short"))


@plan(
    _FILES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY id) + 1 AS row FROM r WHERE layout IN (0, 2))
    SELECT upload_id, row, 'note' AS col, 'Non-numeric characters in NPI field' AS detail FROM n WHERE NOT short AND NOT wide"""
)
def located_errors(spark: SparkSession, d: str) -> DataFrame:
    """Faulty cells of uploaded files with the number of their line in the file, whatever splits it was read in."""
    found = _scanned(spark, d)
    plain = found.kept.where(_part("layout").isin("0", "2"))
    value = lambda k: F.get("values", F.lit(k))
    cells = csv_rows.located(plain, found.lines).select(F.struct("file", "row").alias("at"), value(1).alias("customer"), value(2).alias("note"), "raw")
    errors = csv_scan.parse_errors(cells, "at", "note", "customer", "raw", ["id", "customer", "note"])
    return errors.select(_upload_id("row.file"), F.col("row.row").alias("row"), "col", "detail")
