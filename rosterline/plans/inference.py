"""Queries: value checks and column types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import validators as v
from rosterline.operators.inference import COUNTED, header_type, infer_types
from rosterline.plans import standins as s
from rosterline.plans.catalog import plan

COLUMNS = ["npi", "first_name", "last_name", "specialty", "state", "email", "phone", "zip", "dea", "address", "consent"]

# Names that say nothing, so that only the values decide.
NEUTRAL = {c: f"c{i}" for i, c in enumerate(COLUMNS)}


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace("++", "+") + "'"


NORMAL = "trim(coalesce(CAST({c} AS VARCHAR), ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))"

SQL_CHECKS = {
    "npi": f"regexp_matches(x, {_literal(v.NPI_PATTERN)})",
    "email": f"regexp_matches(x, {_literal(v.EMAIL_PATTERN)})",
    "phone": f"regexp_matches(x, {_literal(v.PHONE_PATTERN)})",
    "practiceState": f"regexp_matches(x, {_literal(v.STATE_PATTERN)})",
    "boolean": f"lower(x) IN ({_quoted(v.TRUE_WORDS + v.FALSE_WORDS)})",
    "firstName": f"regexp_matches(x, {_literal(v.NAME_PATTERN)})",
    "specialty": f"(length(x) >= 3 AND regexp_matches(x, {_literal(v.SPECIALTY_PATTERN)}))",
}


def infer_sql(columns: dict[str, str], source: str) -> str:
    """Column types in SQL: ``columns`` maps a source column to the reported name."""
    counts = ", ".join(f"{s.n_if(SQL_CHECKS[k])} AS {k}" for k in COUNTED)
    per_column = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{name}' AS col, '{header_type(name) or ''}' AS header, "
        f"count(nullif(x, '')) AS non_empty, {counts} FROM (SELECT {NORMAL.format(c=c)} AS x FROM {source})"
        for i, (c, name) in enumerate(columns.items())
    )
    best = "greatest(npi, email, phone, practiceState, boolean, firstName, specialty)"
    winner = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in COUNTED)
    return f"""SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", non_empty,
        round(CASE WHEN header NOT IN ('', 'boolean') THEN NULL WHEN non_empty = 0 THEN 0 ELSE {best} / non_empty END, 4) AS best_share,
        CASE WHEN header NOT IN ('', 'boolean') THEN header
             WHEN header = 'boolean' AND non_empty > 0 AND boolean / non_empty >= 0.9 THEN 'boolean'
             WHEN non_empty = 0 OR {best} / non_empty < 0.5 THEN 'string'
             ELSE CASE {winner} END END AS inferred_type
        FROM ({per_column})"""


def _report(types: DataFrame) -> DataFrame:
    return types.select("ordinal", "column", "non_empty", F.round("best_share", 4).alias("best_share"), "inferred_type")


@plan(s.sql("records", infer_sql({c: c for c in COLUMNS}, "records")))
def column_types(spark: SparkSession, d: str) -> DataFrame:
    return _report(infer_types(s.records(spark, d), COLUMNS))


@plan(s.sql("records", infer_sql(NEUTRAL, "records")))
def column_types_by_value(spark: SparkSession, d: str) -> DataFrame:
    return _report(infer_types(s.records(spark, d).selectExpr(*[f"{c} AS {n}" for c, n in NEUTRAL.items()])))


@plan(s.sql("records", infer_sql(NEUTRAL, "(SELECT * FROM records ORDER BY record_id LIMIT 5)")))
def column_types_of_first_rows(spark: SparkSession, d: str) -> DataFrame:
    renamed = s.records(spark, d).selectExpr("record_id", *[f"{c} AS {n}" for c, n in NEUTRAL.items()])
    return _report(infer_types(renamed, list(NEUTRAL.values()), sample_rows=5, order_by=["record_id"]))


_CELLS = "unpivot_cells AS (UNPIVOT (SELECT record_id, npi, first_name, specialty, state, email, phone, consent FROM records) ON npi, first_name, specialty, state, email, phone, consent INTO NAME field VALUE raw)"


@plan(
    s.sql("records", "").rstrip()
    + f", {_CELLS} SELECT field, count(*) AS n, "
    + ", ".join(f"{s.n_if(sql)} AS {k.lower()}_hits" for k, sql in SQL_CHECKS.items())
    + f" FROM (SELECT field, {NORMAL.format(c='raw')} AS x FROM unpivot_cells) GROUP BY field"
)
def value_checks(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every check against every field, whatever the field is called."""
    fields = ["npi", "first_name", "specialty", "state", "email", "phone", "consent"]
    cells = s.records(spark, d).select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    )
    filled = cells.where("raw IS NOT NULL").select("field", v.normalize(F.col("raw")).alias("x"))
    return filled.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(v.CHECKS[k](F.col("x"))).alias(f"{k.lower()}_hits") for k in COUNTED],
    )


LUHN_SQL = """(list_sum(list_transform(range(1, 16), lambda i:
    CASE WHEN i % 2 = 0 THEN CAST(substr({n}, 16 - i, 1) AS INTEGER) * 2
              - CASE WHEN CAST(substr({n}, 16 - i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END
         ELSE CAST(substr({n}, 16 - i, 1) AS INTEGER) END)) % 10 = 0)"""


@plan(
    s.sql(
        "records",
        f"""SELECT company_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN regexp_matches(npi, '^[0-9]{{10}}$')
        THEN {LUHN_SQL.format(n="('80840' || npi)")} ELSE false END) AS valid FROM records GROUP BY 1""",
    )
)
def check_digits(spark: SparkSession, d: str) -> DataFrame:
    valid = F.count_if(v.has_valid_check_digit(F.col("npi"))).alias("valid")
    return s.records(spark, d).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), valid)


@plan(
    s.sql(
        "records",
        f"""SELECT company_id, count(*) FILTER (WHERE lower(trim(consent)) IN ({_quoted(v.TRUE_WORDS)})) AS agreed,
        count(*) FILTER (WHERE lower(trim(consent)) IN ({_quoted(v.FALSE_WORDS)})) AS refused,
        count(*) FILTER (WHERE lower(trim(consent)) NOT IN ({_quoted(v.TRUE_WORDS + v.FALSE_WORDS)})) AS unknown
        FROM records GROUP BY 1""",
    )
)
def consent_words(spark: SparkSession, d: str) -> DataFrame:
    answer = v.consent(F.col("consent"))
    return (
        s.records(spark, d)
        .groupBy("company_id")
        .agg(
            F.count_if(answer).alias("agreed"),
            F.count_if(~answer).alias("refused"),
            F.count_if(answer.isNull()).alias("unknown"),
        )
    )
