"""Uploaded CSV files: admission, scan with quarantine, and ingest report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.functions.text import base_name, extension
from rosterline.functions.validators import normalize
from rosterline.operators.inference import decide, infer_types, value_counts
from rosterline.sources.csv_check import CONTENT, FIELD, OUTSIDE_TO_OUTSIDE

CORRUPT = "_corrupt_record"

# A reader that skips columns no longer notices rows of the wrong width, hence no column pruning.
OPTIONS = {
    "header": "true",
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "columnPruning": "false",
}

# Accepted extensions, size limit, preview length and longest phone text.
EXTENSIONS = ("csv", "xlsx")
MAX_BYTES = 50 * 1024 * 1024
PREVIEW_ROWS = 5
MAX_PHONE = 14


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def admission(files: DataFrame) -> DataFrame:
    """Accept or reject files by extension, then by size."""
    verdict = (
        F.when(~extension(F.col("path")).isin(*EXTENSIONS), "error-type")
        .when(F.col("length") > MAX_BYTES, "error-size")
        .otherwise("accept")
    )
    return files.withColumn("file_name", base_name(F.col("path"))).withColumn("verdict", verdict)


@dataclass(frozen=True)
class CsvScan:
    """A CSV scan with a header: rows to keep and rows set aside."""

    rows: DataFrame
    quarantine: DataFrame
    columns: list[str]


def scan(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, file: str | None = None
) -> CsvScan:
    """Read CSV files with one header layout, every column as text.

    Short rows are padded with NULL and marked in ``_short``; long rows go to the quarantine as raw
    text. ``multi_line`` is needed only for files whose quoted fields span lines (see
    ``csv_check.structure_faults``), since such files cannot be split. ``file`` names a column for the
    path of each row's file.
    """
    reader = spark.read.options(**OPTIONS).option("multiLine", multi_line)
    columns = reader.csv(path).columns
    raw = reader.schema(raw_schema(columns)).csv(path)
    if file is not None:
        raw = raw.withColumn(file, F.col("_metadata.file_path"))
    rows, quarantine = split(raw, columns, () if file is None else (file,))
    return CsvScan(rows, quarantine, columns)


def raw_schema(columns: list[str]) -> T.StructType:
    """Every column as text, and the raw line of rows that are too short or too long."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def split(raw: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows to use, short ones marked in ``_short``, and the others as raw text; both with ``keep``.

    A row of the wrong width is short only if its fields, counted by the strict grammar, are too few and the
    parser filled no last column. Long rows, and those on which count and parser disagree, are set aside.
    """
    # a query that reads nothing but the corrupt record is refused, so the text falls back to a column
    text = F.coalesce(F.col(CORRUPT), F.col(f"`{columns[0]}`"))
    width = F.size(F.split(F.regexp_replace(text, rf'(^|,)"{CONTENT}"(?=,|\z)', "$1"), ",", -1))
    odd = F.col(CORRUPT).isNotNull()
    short = text.rlike(rf"^{FIELD}(?:,{FIELD})*+\z") & (width < len(columns)) & F.col(f"`{columns[-1]}`").isNull()
    rows = raw.where(~odd | short).select(*[F.col(f"`{c}`") for c in columns], odd.alias("_short"), *keep)
    quarantine = raw.where(odd & ~short).select(F.col(CORRUPT).alias("raw"), width.alias("fields"), *keep)
    return rows, quarantine


def ingest_report(scanned: CsvScan, sample_rows: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Row total and, per column, the inferred type; one row per column.

    Totals always come from all rows; ``sample_rows`` only limits what the types are inferred from.
    """
    report = decide(value_counts(scanned.rows, scanned.columns)).withColumnRenamed("records", "total_rows")
    if sample_rows is not None:
        types = infer_types(scanned.rows, scanned.columns, sample_rows, order_by)
        report = report.drop("inferred_type").join(types.select("ordinal", "inferred_type"), "ordinal")
    return report.select("total_rows", "ordinal", "column", "non_empty", "inferred_type")


def preview(rows: DataFrame, order_by: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    return rows.orderBy(*order_by).limit(n)


def parse_errors(rows: DataFrame, row: str, npi: str, phone: str, raw: str, columns: list[str]) -> DataFrame:
    """``row, col, detail`` for every faulty cell: open quote, non-numeric number, phone too long.

    Open quotes are judged on the ``raw`` line by the strict grammar, since parsed cells may hold any quotes;
    ``columns`` are those of the line.
    """

    def error(condition: Column, column: str, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(column).alias("col"), detail.alias("detail")))

    line = F.col(raw)
    opened = rf'^((?:{FIELD},)*+)"{CONTENT}$'
    before = F.regexp_extract_all(F.regexp_extract(line, opened, 1), F.lit(f"({FIELD},)"), F.lit(1))
    unclosed = F.struct(
        F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in columns]), F.size(before) + 1), F.lit("")).alias("col"),
        F.lit("Unclosed quote in field value").alias("detail"),
    )
    number, call = normalize(F.col(npi)), normalize(F.col(phone))
    length = F.char_length(call)
    too_long = F.concat(
        F.lit("Field contains "), length.cast("string"), F.lit(f" characters — exceeds {MAX_PHONE}-char phone max")
    )
    found = F.array_compact(
        F.array(
            F.when(~line.rlike(OUTSIDE_TO_OUTSIDE) & line.rlike(opened), unclosed),
            error((number != "") & ~number.rlike("^[0-9]+$"), npi, F.lit("Non-numeric characters in NPI field")),
            error(length > MAX_PHONE, phone, too_long),
        )
    )
    return rows.select(F.col(row).alias("row"), F.inline(found))


def storage_path(company: Column, upload: Column, file_name: Column) -> Column:
    """Where the raw file of an upload is kept; the name is reduced to its last path element."""
    return F.concat(F.lit("companies/"), company, F.lit("/uploads/"), upload, F.lit("_"), base_name(file_name))
