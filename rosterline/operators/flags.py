"""All detectors as one list of flags, and the release of records after the decisions on them.

A flag is ``company_id, flag_id, category, record_id, field, issue_type, severity, score, reason, resolved``; its id
is made of category, field and record, so that another run of the detectors finds the same flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.operators import outliers, pii, registry, review
from rosterline.operators.skew import copied
from rosterline.sources import exports

COLUMNS = ("company_id", "flag_id", "category", "record_id", "field", "issue_type", "severity", "score", "reason", "resolved")

# What the reviewer reads.
NOT_FOUND = "NPI not found in NPPES registry"
INACTIVE = "NPI is inactive since "
INVALID = "NPI check digit invalid"
REGISTERED, UPLOADED = "NPI specialty mismatch — registered as ", ", uploaded as "
OFF_DOMAIN = "Email domain does not match registered practice location"
SPREAD, IMPLAUSIBLE = "Prescribing pattern spans ", " states — geographically implausible"


def _flag(
    category: str, field: Column, issue_type: Column, severity: Column, score: Column | None, reason: Column, name: Column | None = None
) -> Column:
    return F.struct(
        F.concat_ws(":", F.lit(category), field if name is None else name, F.col("record_id").cast("string")).alias("flag_id"),
        F.lit(category).alias("category"),
        field.alias("field"),
        issue_type.alias("issue_type"),
        severity.alias("severity"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
        reason.alias("reason"),
    )


def _listed(rows: DataFrame, each: list[Column], more: Column | None = None) -> DataFrame:
    """The flags of ``each`` that aren't null, and those of the array ``more``.

    The arrays are columns before they are taken apart, since a generator evaluates lambdas in its argument, and all
    around them, without compiled code. Two columns: from one, Spark would infer a filter that makes the array again.
    """
    found = F.array(*each)
    if more is not None:
        rows = rows.select("company_id", "record_id", found.alias("_each"), more.alias("_more"))
        found = F.concat("_each", "_more")
    exploded = rows.select("company_id", "record_id", F.inline(found)).where("flag_id IS NOT NULL")
    return exploded.withColumn("resolved", F.lit(False)).select(*COLUMNS)


def of_records(
    records: DataFrame,
    known: DataFrame,
    companies: DataFrame,
    personal: dict[str, str],
    texts: tuple[str, ...] = (),
    group: str = "specialty",
    value: str = "volume",
    expiry: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Registry errors, outliers and personal data of all records in one pass over them.

    ``personal`` tells what columns hold by a name of ``pii.COLUMN_RULES``, ``texts`` are searched for personal data.
    ``expiry`` is a date that lies implausibly far behind ``as_of`` or not.
    """
    domains = companies.select("company_id", F.lower("email_domain").alias("_expected"))
    checked = registry.validate(records, known).withColumnRenamed("severity", "_npi_severity").join(domains, "company_id", "left")
    rows = outliers.with_scores(checked, group, value, "left", records)
    issue, ratio = F.col("issue_type"), F.col("ratio")
    reason = (
        F.when(issue == "Inactive", F.concat(F.lit(INACTIVE), F.coalesce(F.col("deactivated_year").cast("string"), F.lit("?"))))
        .when(issue == "Mismatch", F.concat(F.lit(REGISTERED), "registry_specialty", F.lit(UPLOADED), "specialty"))
        .when(issue == "Invalid", INVALID)
        .when(issue == "Not Found", NOT_FOUND)
    )
    mean = F.concat(F.lower(F.col(group)), F.lit(f" {group} average"))
    distance = F.when(
        ratio >= outliers.RATIO, F.concat(F.lit(f"{value} "), F.floor(ratio).cast("string"), F.lit("x above "), mean)
    ).otherwise(F.concat(F.lit(f"{value} far from "), mean))
    email = F.lower(F.col("email"))
    off = F.contains(email, F.lit("@")) & (F.split_part(email, F.lit("@"), F.lit(2)) != F.col("_expected"))
    each = [
        F.when(issue.isNotNull(), _flag("npi_validation", F.lit("npi"), issue, F.col("_npi_severity"), None, reason)),
        F.when(outliers.distant(), _flag("outliers", F.lit(value), F.lit("Statistical"), F.col("severity"), F.col("anomaly_score"), distance)),
        F.when(off, _flag("outliers", F.lit("email"), F.lit("Domain"), F.lit("Medium"), None, F.lit(OFF_DOMAIN))),
    ]
    if expiry is not None:
        late = F.col(expiry).cast("date") > F.add_months(F.lit(as_of).cast("date"), 12 * outliers.MAX_YEARS_AHEAD)
        ahead = (F.year(expiry) - F.year(F.lit(as_of).cast("date"))).cast("string")
        why = F.concat(F.lit("License expiry date "), ahead, F.lit(" years in the future"))
        each.append(F.when(late, _flag("outliers", F.lit(expiry), F.lit("Expiry"), F.lit("Low"), None, why)))
    hits = F.transform(
        pii.hits(personal, texts),
        lambda h: _flag(
            "PII", h["column"], h["type"], h["severity"], None, F.concat(h["type"], F.lit(" in "), h["column"]),
            F.concat_ws("/", h["column"], h["field"]),
        ),
    )
    return _listed(rows, each, hits)


def of_pairs(pairs: DataFrame, block: str = "npi") -> DataFrame:
    """Flags of duplicate pairs, on the second record; the score is the pair's ``similarity`` where it is given."""
    similarity = F.col("similarity") / 100 if "similarity" in pairs.columns else None
    reason = F.concat(F.lit(f"Same {block} as record "), F.col("rec1").cast("string"))
    named = pairs.withColumns({"record_id": F.col("rec2"), "company_id": F.col("b.company_id")})
    return _listed(named, [_flag("duplicates", F.lit(block), F.lit("Same " + block), F.lit("Medium"), similarity, reason)])


def of_spread(records: DataFrame, activity: DataFrame, state: str = "state", limit: int = outliers.MAX_STATES) -> DataFrame:
    """Flags of records with ``activity`` (``record_id`` and a state) in more than ``limit`` states."""
    found = outliers.spread(activity, ["record_id"], state, limit).select(copied(F.col("record_id")).alias("_of"), "states")
    named = records.select("company_id", "record_id").join(found, F.col("record_id").cast("string") == F.col("_of"))
    reason = F.concat(F.lit(SPREAD), F.col("states").cast("string"), F.lit(IMPLAUSIBLE))
    return _listed(named, [_flag("outliers", F.lit(state), F.lit("Geographic"), F.lit("Medium"), None, reason)])


def cleared(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of tenants whose gate is open; a tenant without flags has an open gate. One row per closed tenant is joined."""
    closed = exports.gate(decided, ["company_id"]).where("NOT available").select(copied(F.col("company_id")).alias("_closed"))
    return rows.join(closed, F.col("company_id").cast("string") == F.col("_closed"), "left_anti")


def release(records: DataFrame, decided: DataFrame, pairs: DataFrame, sensitive: list[str]) -> DataFrame:
    """Records that may leave: none that was removed or lost to its duplicate, flagged values anonymised, warned ones tagged.

    ``decided`` are flags with their decisions, ``pairs`` has ``rec1, rec2``. All joins are on the record, so that
    records are shuffled once.
    """
    doubles = F.col("category") == "duplicates"
    verdicts = decided.where(doubles & F.col("action").isNotNull()).select(F.col("record_id").alias("rec2"), "action", "master")
    kept = review.drop_removed(records, decided.where(~doubles))
    kept = review.surviving_records(kept, pairs.select("rec1", "rec2").join(verdicts, "rec2"))
    return review.tag_warnings(review.anonymize(kept, decided, sensitive), review.quality_warnings(decided))
