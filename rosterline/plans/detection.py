"""Queries: personal data, duplicates, outliers, registry errors and regulated phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import text as t
from rosterline.operators import compliance, flags, linkage, outliers, pii, registry, review, score, search
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan
from rosterline.plans.inference import LUHN_SQL
from rosterline.runtime import scratch, table

# --- duplicates ---------------------------------------------------------------------------------

_PAIRS = f""", named AS (SELECT *, min(record_id) OVER (PARTITION BY npi) AS rec1 FROM records),
    pairs AS (SELECT b.npi AS block, b.rec1, b.record_id AS rec2,
        {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in linkage.COMPARED)}
        FROM named b JOIN records a ON a.record_id = b.rec1 WHERE b.rec1 <> b.record_id)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.duplicate_pairs(s.records(spark, d))


@plan(s.sql("records", _PAIRS + "SELECT block, rec1, rec2 FROM pairs"))
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("block", "rec1", "rec2")


def _similar(c: str) -> str:
    a, b = (f"lower(trim(coalesce({x}_{c}, '')))" for x in "ab")
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


_SIMILARITY = f"CAST(floor((0.0::DOUBLE + {' + '.join(_similar(c) for c in linkage.SCORED)}) / 8 * 100 + 0.5) AS BIGINT)"


@plan(
    s.sql(
        "records",
        _PAIRS
        + f"""SELECT rec1, rec2, similarity, CASE WHEN similarity >= 95 THEN 'danger' WHEN similarity >= 85 THEN 'warning'
        ELSE 'info' END AS band FROM (SELECT rec1, rec2, {_SIMILARITY} AS similarity FROM pairs)""",
    )
)
def duplicate_similarity(spark: SparkSession, d: str) -> DataFrame:
    return linkage.with_similarity(_pairs(spark, d)).select("rec1", "rec2", "similarity", "band")


@plan(
    s.sql(
        "records",
        _PAIRS
        + "SELECT rec1, rec2, concat_ws(',', "
        + ", ".join(f"CASE WHEN a_{c} IS DISTINCT FROM b_{c} THEN '{c}' END" for c in linkage.COMPARED)
        + """) AS fields, CASE WHEN a_source = b_source THEN 'Same upload' ELSE 'Cross-upload' END AS origin
        FROM pairs""",
    )
)
def duplicate_differences(spark: SparkSession, d: str) -> DataFrame:
    compared = linkage.with_origin(linkage.with_differences(_pairs(spark, d)))
    fields = F.array_join(F.transform("differences", lambda x: x["field"]), ",")
    return compared.select("rec1", "rec2", fields.alias("fields"), "origin")


@plan(
    s.sql(
        "records",
        _PAIRS
        + f"""SELECT rec1, rec2, similarity FROM (SELECT rec1, rec2, {_SIMILARITY} AS similarity FROM pairs)
        ORDER BY similarity DESC, rec2""",
    )
)
def duplicate_review_list(spark: SparkSession, d: str) -> DataFrame:
    scored = linkage.with_similarity(_pairs(spark, d)).select("rec1", "rec2", "similarity")
    return search.ordered(scored, "similarity", "rec2")


@plan(
    s.sql(
        "records",
        _PAIRS + "SELECT rec1, rec2, concat_ws(' ', a_last_name, a_first_name) AS name FROM pairs ORDER BY name, rec2",
    )
)
def duplicate_list_by_name(spark: SparkSession, d: str) -> DataFrame:
    listed = linkage.by_name(_pairs(spark, d))
    return listed.select("rec1", "rec2", F.concat_ws(" ", "a.last_name", "a.first_name").alias("name"))


@plan(
    s.sql(
        "records resolutions latest",
        _PAIRS
        + """, losers AS (SELECT CASE WHEN master = 2 THEN rec1 ELSE rec2 END AS record_id FROM pairs
            JOIN latest ON flag_id = rec2 WHERE action IN ('merged', 'removed'))
        SELECT record_id, npi FROM records WHERE record_id NOT IN (SELECT record_id FROM losers)""",
    )
)
def surviving_records(spark: SparkSession, d: str) -> DataFrame:
    """Records after the decisions on duplicate pairs; the second record identifies the pair."""
    decisions = review.latest(s.resolutions(spark, d)).select(F.col("flag_id").alias("rec2"), "action", "master")
    pairs = _pairs(spark, d).select("rec1", "rec2").join(decisions, "rec2")
    return review.surviving_records(s.records(spark, d), pairs).select("record_id", "npi")


# --- outliers -----------------------------------------------------------------------------------


@plan(
    """WITH stats AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd, quantile_disc(value, 0.99) AS p99
        FROM events GROUP BY 1),
    scored AS (SELECT event_id, event_type, (value - m) / sd AS z, value / m AS ratio, value > p99 AS above_p99
        FROM events JOIN stats USING (event_type)),
    banded AS (SELECT *, 1 - 1 / (1 + abs(z)) AS a FROM scored WHERE abs(z) > 3 OR ratio >= 10 OR above_p99)
    SELECT event_id, event_type, round(z, 4) AS z, round(ratio, 4) AS ratio, above_p99, round(a, 4) AS anomaly_score,
        CASE WHEN a >= 0.85 THEN 'High' WHEN a >= 0.70 THEN 'Medium' ELSE 'Low' END AS severity FROM banded"""
)
def statistical_outliers(spark: SparkSession, d: str) -> DataFrame:
    found = outliers.statistical_outliers(table(spark, d, "events"), "event_type", "value")
    rounded = [F.round(c, 4).alias(c) for c in ("z", "ratio", "anomaly_score")]
    return found.select("event_id", "event_type", *rounded, "above_p99", "severity")


@plan(
    """SELECT l_suppkey, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT c_nationkey) AS states
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2 HAVING count(DISTINCT c_nationkey) > 10"""
)
def geographic_spread(spark: SparkSession, d: str) -> DataFrame:
    activity = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
        .select("l_suppkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "c_nationkey")
    )
    return outliers.geographic_spread(activity, ["l_suppkey", "month"], "c_nationkey")


_EXPIRY = "o_orderdate + INTERVAL 20 YEARS"


@plan(f"SELECT o_orderkey FROM orders WHERE CAST({_EXPIRY} AS DATE) > DATE '2020-06-15'")
def implausible_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Licences that run for twenty years, seen from the middle of the year 2000."""
    licences = table(spark, d, "orders").withColumn("expiry", F.expr(_EXPIRY))
    return outliers.implausible_expiry(licences, "expiry", "2000-06-15").select("o_orderkey")


@plan(
    s.sql(
        "records companies",
        """SELECT record_id, split_part(email, '@', 2) AS actual_domain, email_domain AS expected_domain
        FROM records JOIN companies USING (company_id)
        WHERE contains(email, '@') AND split_part(lower(email), '@', 2) <> email_domain""",
    )
)
def domain_mismatch(spark: SparkSession, d: str) -> DataFrame:
    found = outliers.domain_mismatch(s.records(spark, d), s.companies(spark, d), "company_id")
    return found.select("record_id", "actual_domain", "expected_domain")


# --- registry -----------------------------------------------------------------------------------

_VALID = f"(CASE WHEN regexp_matches(r.npi, '^[0-9]{{10}}$') THEN {LUHN_SQL.format(n="('80840' || r.npi)")} ELSE false END)"
_CHECKED = f""", checked AS (SELECT record_id, concat_ws(',', CASE WHEN g.status <> 'Active' THEN 'Inactive' END,
        CASE WHEN lower(g.specialty) <> lower(r.specialty) THEN 'Mismatch' END,
        CASE WHEN NOT {_VALID} THEN 'Invalid' END, CASE WHEN g.npi IS NULL THEN 'Not Found' END) AS issues
        FROM records r LEFT JOIN registry g ON g.npi = r.npi),
    errors AS (SELECT *, split_part(issues, ',', 1) AS issue_type FROM checked WHERE issues <> '')"""
_SEVERITY = "CASE WHEN issue_type IN ('Invalid', 'Not Found') THEN 'High' ELSE 'Medium' END"


@plan(s.sql("records registry", _CHECKED + f"SELECT record_id, issues, issue_type, {_SEVERITY} AS severity FROM errors"))
def registry_errors(spark: SparkSession, d: str) -> DataFrame:
    found = registry.errors(registry.validate(s.records(spark, d), s.registry(spark, d)))
    return found.select("record_id", F.array_join("issues", ",").alias("issues"), "issue_type", "severity")


@plan(s.sql("records", "SELECT company_id, count(*) AS pending FROM records GROUP BY 1"))
def registry_pending(spark: SparkSession, d: str) -> DataFrame:
    waiting = registry.validate(s.records(spark, d), None).where("issue_type = 'pending'")
    return waiting.groupBy("company_id").agg(F.count(F.lit(1)).alias("pending"))


# --- personal data and phrases in text ------------------------------------------------------------

_TEXTS = """, texts AS (SELECT concat('d', doc_id) AS id, text FROM documents
    UNION ALL SELECT concat('c', conv_id, '.', turn), text FROM conversations)"""


def _hits_sql(field: str, severity: str, pattern: str, keep: str = "true") -> str:
    return f"""SELECT id, '{field}' AS field, '{severity}' AS severity, value FROM (
        SELECT id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM texts) WHERE {keep}"""


SSN_SQL = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD_SQL = r"\b(?:[0-9]{4}[ -]?){3}[0-9]{1,4}\b"
EMAIL_SQL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

_CARD = """(list_sum(list_transform(range(0, length(n)), lambda i: CASE WHEN i % 2 = 1
    THEN CAST(substr(n, CAST(length(n) - i AS BIGINT), 1) AS INTEGER) * 2
        - CASE WHEN CAST(substr(n, CAST(length(n) - i AS BIGINT), 1) AS INTEGER) > 4 THEN 9 ELSE 0 END
    ELSE CAST(substr(n, CAST(length(n) - i AS BIGINT), 1) AS INTEGER) END)) % 10 = 0)"""


@plan(
    "WITH "
    + _TEXTS.removeprefix(", ")
    + f""", cards AS (SELECT id, field, severity, value, regexp_replace(value, '[ -]', '', 'g') AS n FROM (
        {_hits_sql("Credit Card", "High", CARD_SQL)}))
    {_hits_sql("SSN", "High", SSN_SQL)} UNION ALL
    SELECT id, field, severity, value FROM cards WHERE {_CARD} UNION ALL
    {_hits_sql("Personal Email", "Low", EMAIL_SQL)}"""
)
def pii_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in whole documents and conversation turns."""
    documents = table(spark, d, "documents").selectExpr("concat('d', doc_id) AS id", "text")
    turns = table(spark, d, "conversations").selectExpr("concat('c', conv_id, '.', turn) AS id", "text")
    return pii.in_text(documents.unionByName(turns), "text", ["id"]).select("id", "field", "severity", "value")


@plan(
    s.sql(
        "records",
        """SELECT record_id, 'Home Address' AS field, 'High' AS severity, address AS value FROM records
        WHERE trim(coalesce(address, '')) <> '' UNION ALL
        SELECT record_id, 'DOB', 'Medium', strftime(updated_at, '%Y-%m-%d') FROM records""",
    )
)
def pii_in_columns(spark: SparkSession, d: str) -> DataFrame:
    named = s.records(spark, d).select(
        "record_id", F.col("address").alias("home_address"), F.date_format("updated_at", "yyyy-MM-dd").alias("dob")
    )
    return pii.in_columns(named, ["record_id"]).select("record_id", "field", "severity", "value")


# Phrases that occur in the given texts, in the roles of regulated ones.
PHRASES = (
    compliance.Phrase("Apache License", "Off-Label", "High", "ref 1", "approved license"),
    compliance.Phrase("MIT License", "State Restriction", "Medium", "ref 2", "stated license"),
    compliance.Phrase("GNU General Public License", "Sunshine Act", "High", "ref 3", "public license"),
    compliance.Phrase("cc by-nc", "Off-Label", "Low", "ref 4", "shared work"),
)

_LEXICON = ", ".join(f"('{p.phrase}', '{p.violation}', '{p.severity}', '{p.ref}', '{p.suggestion}')" for p in PHRASES)
_MATCHES = f"""WITH lexicon (phrase, violation, severity, ref, suggestion) AS (VALUES {_LEXICON}),
    matches AS (SELECT doc_id, source, lexicon.*, CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'overridden'
        ELSE 'open' END AS status
        FROM documents LEFT JOIN labels USING (doc_id) JOIN lexicon ON contains(lower(text), lower(phrase)))"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Phrase hits with a review status taken from the document's label."""
    hits = compliance.scan(table(spark, d, "documents"), "text", ["doc_id", "source"], PHRASES)
    labelled = hits.join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "overridden").otherwise("open")
    return labelled.withColumn("status", status).drop("quality", "toxic")


@plan(_MATCHES + " SELECT doc_id, source, phrase, violation, severity, ref, suggestion, status FROM matches")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


_COUNTS = f"""count(*) AS flags, {s.n_if("severity = 'High' AND status = 'open'")} AS high_open,
    {s.n_if("status <> 'open'")} AS resolved, {s.n_if("severity = 'High' AND status = 'open'")} = 0 AS all_high_resolved"""


@plan(f"{_MATCHES} SELECT source, {_COUNTS} FROM matches GROUP BY 1")
def compliance_counts(spark: SparkSession, d: str) -> DataFrame:
    return compliance.counts(_matches(spark, d), ["source"])


@plan(
    f"""{_MATCHES} SELECT source, coalesce(all_high_resolved, true) AS available, CASE WHEN high_open > 0 THEN
        concat('Export blocked: ', high_open, ' High-severity flag', CASE WHEN high_open > 1 THEN 's' ELSE '' END,
        ' must be resolved before exporting campaign assets.') END AS block_reason
        FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, {_COUNTS} FROM matches WHERE source <> 'src3' GROUP BY 1) USING (source)"""
)
def campaign_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate of every source; one of them has no flags."""
    return compliance.campaign_gate(_matches(spark, d).where("source <> 'src3'"), ["source"], table(spark, d, "documents"))


_REPLACED = "text"
for _p in PHRASES:
    _REPLACED = f"regexp_replace({_REPLACED}, '{_p.phrase}', '{_p.suggestion}', 'gi')"


@plan(f"SELECT doc_id, CASE WHEN quality = 1 THEN {_REPLACED} ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id)")
def accepted_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with the suggestions of accepted hits in place of their phrases; open and overridden hits stay."""
    accepted = _matches(spark, d).where("status = 'accepted'").groupBy("doc_id").agg(F.collect_set("phrase").alias("accepted"))
    found = table(spark, d, "documents").join(accepted, "doc_id", "left")
    return found.select("doc_id", t.replace_accepted(F.col("text"), {p.phrase: p.suggestion for p in PHRASES}, F.col("accepted")).alias("text"))



@plan(
    _MATCHES.replace("WITH lexicon", "WITH RECURSIVE lexicon", 1)
    + """, found AS (SELECT doc_id, text, phrase, 0 AS from_, instr(lower(text), lower(phrase)) - 1 AS start FROM documents JOIN matches USING (doc_id)
        UNION ALL SELECT doc_id, text, phrase, start + length(phrase), start + length(phrase)
            + instr(lower(substr(text, start + length(phrase) + 1)), lower(phrase)) - 1
        FROM found WHERE contains(lower(substr(text, start + length(phrase) + 1)), lower(phrase)))
    SELECT doc_id, phrase, start AS start, start + length(phrase) AS stop FROM found"""
)
def phrase_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each regulated phrase stands in a text, all of them found in one pass."""
    hits = F.inline(t.phrase_hits(F.col("text"), [p.phrase for p in PHRASES]))
    return table(spark, d, "documents").select("doc_id", hits).select("doc_id", "phrase", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


_STATS = """, stats AS (SELECT specialty, avg(volume) AS m, stddev_samp(volume) AS sd, quantile_disc(volume, 0.99) AS p99
        FROM records GROUP BY 1),
    scored AS (SELECT r.*, 1 - 1 / (1 + abs((volume - m) / sd)) AS a,
        abs((volume - m) / sd) > 3 OR volume / m >= 10 OR volume > p99 AS distant, volume / m AS ratio
        FROM records r JOIN stats USING (specialty))"""


def _flag_sql(category: str, field: str, rest: str, name: str | None = None) -> str:
    return f"""SELECT company_id, '{category}:{name or field}:' || record_id AS flag_id, '{category}' AS category, record_id,
        '{field}' AS field, {rest}, false AS resolved"""


# A record's activity are the line items of its order, each in the state of its supplier; there are seven at most.
SPREAD_LIMIT = 5

_DETECTED = f"""{_CHECKED}{_PAIRS}{_STATS}, detected AS (
    {_flag_sql("npi_validation", "npi", f"""issue_type, {_SEVERITY} AS severity, CAST(NULL AS DOUBLE) AS score,
        CASE issue_type WHEN 'Inactive' THEN 'NPI is inactive since ' || deactivated_year WHEN 'Invalid' THEN 'NPI check digit invalid'
        WHEN 'Mismatch' THEN 'NPI specialty mismatch — registered as ' || g.specialty || ', uploaded as ' || r.specialty
        ELSE 'NPI not found in NPPES registry' END AS reason""")}
        FROM errors JOIN records r USING (record_id) LEFT JOIN registry g ON g.npi = r.npi
    UNION ALL {_flag_sql("duplicates", "npi", "'Same npi', 'Medium', NULL, 'Same npi as record ' || rec1")}
        FROM (SELECT company_id, rec2 AS record_id, rec1 FROM pairs JOIN records ON record_id = rec2)
    UNION ALL {_flag_sql("outliers", "email", "'Domain', 'Medium', NULL, 'Email domain does not match registered practice location'")}
        FROM records JOIN companies USING (company_id)
        WHERE contains(email, '@') AND split_part(lower(email), '@', 2) <> email_domain
    UNION ALL {_flag_sql("outliers", "volume", """'Statistical', CASE WHEN a >= 0.85 THEN 'High' WHEN a >= 0.70 THEN 'Medium' ELSE 'Low' END,
        round(a, 4), 'volume ' || CASE WHEN ratio >= 10 THEN CAST(floor(ratio) AS BIGINT) || 'x above ' ELSE 'far from ' END
        || lower(specialty) || ' specialty average'""")} FROM scored WHERE distant
    UNION ALL {_flag_sql("outliers", "expires", """'Expiry', 'Low', NULL,
        'License expiry date ' || (year(updated_at) - 1980) || ' years in the future'""")}
        FROM records WHERE CAST(updated_at + INTERVAL 20 YEARS AS DATE) > DATE '2020-06-15'
    UNION ALL {_flag_sql("outliers", "state", """'Geographic', 'Medium', NULL,
        'Prescribing pattern spans ' || states || ' states — geographically implausible'""")}
        FROM (SELECT company_id, record_id, count(DISTINCT s_nationkey) AS states FROM records
            JOIN lineitem ON l_orderkey = record_id JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE states > {SPREAD_LIMIT}
    UNION ALL {_flag_sql("PII", "address", "'Physical Address', 'High', NULL, 'Physical Address in address'", "address/Home Address")}
        FROM records WHERE trim(coalesce(address, '')) <> '')"""


def _detected(spark: SparkSession, d: str) -> DataFrame:
    records = s.records(spark, d).withColumn("expires", F.expr("updated_at + INTERVAL 20 YEARS"))
    found = flags.of_records(
        records, s.registry(spark, d), s.companies(spark, d), {"address": "home_address"}, ("address",), expiry="expires", as_of="2000-06-15"
    )
    pairs = linkage.duplicate_pairs(records, fields=("company_id",))
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey AS l_suppkey", "concat('A', char(65 + s_nationkey)) AS state")
    activity = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_suppkey").join(suppliers, "l_suppkey")
    wide = flags.of_spread(records, activity, limit=SPREAD_LIMIT)
    return found.withColumn("score", F.round("score", 4)).unionByName(flags.of_pairs(pairs)).unionByName(wide)


@plan(s.sql("records registry companies", _DETECTED + " SELECT * FROM detected"))
def detected_flags(spark: SparkSession, d: str) -> DataFrame:
    """One flag list from all detectors."""
    return _detected(spark, d)


# A line item decides on one of the flags of its order.
_TARGET = """CASE seq % 4 WHEN 0 THEN 'npi_validation:npi:' WHEN 1 THEN 'PII:address/Home Address:' WHEN 2 THEN 'outliers:email:'
    ELSE 'duplicates:npi:' END"""
_REVIEWED = (
    f"{_DETECTED}, flags AS (SELECT * FROM detected), resolutions AS (SELECT * REPLACE ({_TARGET} || flag_id AS flag_id) FROM log), "
    + ", ".join(f"{name} AS ({s.SQL[name]})" for name in ("accepted", "effective", "decided"))
).replace("SELECT flags.*, action,", "SELECT flags.* EXCLUDE (resolved), action,")
_LOG = f"log AS ({s.SQL['resolutions']}), "
_LEAVING = """, losers AS (SELECT CASE WHEN master = 2 THEN rec1 ELSE rec2 END AS record_id FROM pairs JOIN decided ON record_id = rec2
        WHERE category = 'duplicates' AND action IN ('merged', 'removed')
        UNION SELECT record_id FROM decided WHERE category <> 'duplicates' AND action = 'removed'),
    hidden AS (SELECT record_id FROM decided WHERE action = 'anonymized' AND field = 'address'),
    masked AS (SELECT DISTINCT record_id FROM decided WHERE action = 'anonymized' AND field = 'email'),
    warned AS (SELECT record_id, CASE WHEN coalesce(trim(note), '') = '' THEN 'No note provided' ELSE note END AS note
        FROM decided WHERE action = 'warned')"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Detected flags with their decisions, stored, since score, gate and release all read them.

    The flags are stored before, too, or acceptance and decision would each run all detectors. Both are joined on the
    reversed id: ids begin alike, so a sort that compares their first bytes would have to read on at every step.
    """
    path = scratch(spark, "decided")
    _detected(spark, d).drop("resolved").withColumn("_di", F.reverse("flag_id")).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    resolutions = s.resolutions(spark, d).withColumn("_di", F.reverse(F.expr(f"concat({_TARGET}, flag_id)"))).drop("flag_id")
    decisions = review.latest(review.accepted_overrides(resolutions, found, "_di"), "_di")
    review.with_decision(found, decisions, "_di").drop("_di").write.parquet(f"{path}/decided")
    return spark.read.parquet(f"{path}/decided")


def _review_sql(body: str) -> str:
    return s.sql("records registry companies", _REVIEWED + body).replace("WITH ", "WITH " + _LOG, 1)


@plan(
    _review_sql(
        """, weighted AS (SELECT company_id, lower(category) AS c, resolved,
            CASE WHEN category = 'duplicates' THEN 1 WHEN severity = 'High' THEN 3 WHEN severity = 'Medium' THEN 2 ELSE 1 END AS w FROM decided),
        shares AS (SELECT company_id, c, count(*) AS n, sum(CASE WHEN resolved THEN w ELSE 0 END) / sum(w) AS share
            FROM weighted GROUP BY 1, 2),
        points AS (SELECT company_id, sum(n) AS flags,
            coalesce(any_value(share) FILTER (WHERE c = 'npi_validation'), 1) * 30 + coalesce(any_value(share) FILTER (WHERE c = 'pii'), 1) * 25
            + coalesce(any_value(share) FILTER (WHERE c = 'duplicates'), 1) * 25 + coalesce(any_value(share) FILTER (WHERE c = 'outliers'), 1) * 20 AS p
            FROM shares GROUP BY 1),
        sizes AS (SELECT company_id, count(*) AS total_rows FROM records GROUP BY 1)
        SELECT company_id, CAST(flags AS BIGINT) AS flags,
            CAST(greatest(0, least(100, floor(p - least(5.0, flags / (total_rows / 1000.0) * 0.4) + 0.5))) AS BIGINT) AS score
        FROM sizes JOIN points USING (company_id)"""
    )
)
def review_pipeline_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each company after the decisions on its detected flags."""
    sizes = s.records(spark, d).groupBy("company_id").agg(F.count(F.lit(1)).alias("total_rows"))
    return score.health_score(_reviewed(spark, d), sizes, ["company_id"]).drop("label")


@plan(
    _review_sql(
        _LEAVING
        + """ SELECT record_id, CASE WHEN hidden.record_id IS NULL THEN address ELSE sha256(address) END AS address,
            CASE WHEN masked.record_id IS NULL THEN email ELSE sha256(email) END AS email,
            CASE WHEN note IS NULL THEN '' ELSE '[DATA QUALITY WARNING]' END AS dq_flag, note AS dq_note
        FROM records LEFT JOIN hidden USING (record_id) LEFT JOIN masked USING (record_id) LEFT JOIN warned USING (record_id)
        WHERE record_id NOT IN (SELECT record_id FROM losers)"""
    )
)
def released_list(spark: SparkSession, d: str) -> DataFrame:
    """What may leave after the decisions on the detected flags."""
    records = s.records(spark, d).select("record_id", "npi", "address", "email")
    pairs = linkage.duplicate_pairs(records, fields=("npi",))
    return flags.release(records, _reviewed(spark, d), pairs, ["address", "email"]).drop("npi")
