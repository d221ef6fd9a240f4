"""Consent-filtered exports, their gates and their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.operators.groups import with_all

CONSENT = "has_opted_in"

# Columns of the clean list.
CLEAN_COLUMNS = {
    "dq_flag": "DQ_FLAG",
    "npi": "NPI",
    "first_name": "First Name",
    "last_name": "Last Name",
    "specialty": "Specialty",
    "state": "State",
    "email": "Email",
    "phone": "Phone",
    "zip": "ZIP",
    "dea": "DEA Number",
}


def _consent_column(df: DataFrame, consent: str) -> str | None:
    """The consent column as the table spells it; names are resolved without regard to case, as Spark does."""
    return next((c for c in df.columns if c.lower() == consent.lower()), None)


def _agreed(df: DataFrame, consent: str) -> Column:
    """True where consent is exactly true or the number one; words are no consent."""
    kind = df.schema[consent].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(consent) == F.lit(True)
    if isinstance(kind, T.NumericType):
        return F.col(consent) == F.lit(1)
    return F.lit(False)


def opted_in(df: DataFrame, consent: str = CONSENT) -> DataFrame:
    """Rows with explicit consent. Without a consent column nothing may leave."""
    column = _consent_column(df, consent)
    return df.where(_agreed(df, column)) if column else df.limit(0)


def outcome(df: DataFrame, consent: str = CONSENT) -> DataFrame:
    """One row: ``not_found`` without records, ``empty`` without a consenting one, else ``ok``."""
    column = _consent_column(df, consent)
    agreed = F.count_if(_agreed(df, column)) if column else F.lit(0).cast("long")
    return _with_status(df.agg(F.count(F.lit(1)).alias("records"), agreed.alias("exported")))


def outcomes(companies: DataFrame, df: DataFrame, consent: str = CONSENT) -> DataFrame:
    """:func:`outcome` for every company at once, also for those without any record."""
    column = _consent_column(df, consent)
    agreed = F.count_if(_agreed(df, column)) if column else F.lit(0).cast("long")
    counted = df.groupBy("company_id").agg(F.count(F.lit(1)).alias("records"), agreed.alias("exported"))
    joined = companies.select("company_id").join(counted, "company_id", "left")
    return _with_status(joined.fillna(0, ["records", "exported"]))


def _with_status(counted: DataFrame) -> DataFrame:
    status = F.when(F.col("records") == 0, "not_found").when(F.col("exported") == 0, "empty").otherwise("ok")
    return counted.withColumn("status", status)


def _cell(name: str, kind: str) -> Column:
    """Text of a cell: NULL is empty, booleans are capitalised, binary text is made valid UTF-8."""
    value = F.col(f"`{name}`")
    if kind == "binary":
        value = F.call_function("make_valid_utf8", value.cast("string"))
    elif kind == "boolean":
        value = F.initcap(value.cast("string"))
    return F.coalesce(value.cast("string"), F.lit("")).alias(name)


def for_crm(df: DataFrame, consent: str = CONSENT) -> DataFrame:
    """What a CRM gets: consenting rows, every cell as text, no NULL."""
    allowed = opted_in(df, consent)
    return allowed.select(*[_cell(c, kind) for c, kind in allowed.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header and minimal quoting; empty cells stay bare and quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def clean_list(tagged: DataFrame) -> DataFrame:
    """The clean list: ``DQ_FLAG`` first, warned records kept and tagged."""
    return tagged.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in CLEAN_COLUMNS.items()])


def clean_lines(tagged: DataFrame, role: str, by: str = "company_id") -> DataFrame:
    """The clean lists of all tenants as lines: ``by, section, line``; section 0 is the header, 1 a record, 2 the trailer."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in CLEAN_COLUMNS.items()]
    as_csv = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = tagged.select(by, F.lit(1).alias("section"), F.to_csv(F.struct(*cells), as_csv).alias("line"))
    ends = clean_list_summary(tagged, role, [by])
    header = F.struct(F.lit(0).alias("section"), F.lit(",".join(CLEAN_COLUMNS.values())).alias("line"))
    trailer = F.struct(F.lit(2).alias("section"), F.col("trailer").alias("line"))
    return rows.unionByName(ends.select(by, F.inline(F.array(header, trailer))))


def write_clean_lists(tagged: DataFrame, path: str, role: str, by: str = "company_id") -> None:
    """One folder per tenant with its list as text, in order. The header comes first and the trailer last over its files."""
    lines = clean_lines(tagged, role, by)
    lines.repartitionByRange(by, "section", "line").sortWithinPartitions(by, "section", "line").select(by, "line").write.partitionBy(by).text(path)


def clean_list_summary(tagged: DataFrame, role: str, by: list[str] | None = None) -> DataFrame:
    """The figures of the list's trailing line, as one row, or one for each value of ``by``."""
    counted = tagged.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("dq_flag") != "").alias("dq_warnings"))
    line = F.concat(
        F.lit("# "),
        F.format_number("records", 0),
        F.lit(" total records · "),
        F.col("dq_warnings").cast("string"),
        F.lit(f" DQ warnings · Role: {role}"),
    )
    return counted.withColumn("trailer", line)


def gate(flags: DataFrame, by: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Whether the clean list may be exported: no open High provider-number error.

    ``groups`` has all values of ``by``, null being one; one without flags is available.
    """
    by = by or []
    is_open = ~F.coalesce("resolved", F.lit(False))
    serious = (F.lower("category") == "npi_validation") & (F.col("severity") == "High") & is_open
    n = F.col("open_high")
    reason = F.concat(
        n.cast("string"),
        F.when(n > 1, " High-severity NPI errors").otherwise(" High-severity NPI error"),
        F.lit(" must be resolved in Data Review before export."),
    )
    counted = flags.groupBy(*by).agg(F.count_if(serious).alias("open_high"))
    if groups is not None:
        counted = with_all(counted, groups, by).fillna(0, ["open_high"])
    return (
        counted.select(*by, "open_high", (n == 0).alias("available"), F.when(n > 0, reason).alias("block_reason"))
    )


def log(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append export events ``format, file_name, size, role, records, timestamp`` with their time.

    With a ``batch`` id the events of a batch have a folder of their own, so a job that runs again doesn't log twice.
    """
    timed = events.withColumn("created_at", F.current_timestamp())
    if batch is None:
        timed.write.mode("append").parquet(path)
    else:
        timed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
