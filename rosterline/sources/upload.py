"""Uploaded CSV files in one go: structure check, one scan of all files whatever their layouts, mapping, upload rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.text import base_name
from rosterline.runtime import scratch
from rosterline.sources import csv_check, csv_rows, csv_scan

FILE = "_file"


@dataclass(frozen=True)
class Upload:
    """Rows to keep and rows set aside, each with its ``_file``, and a verdict per file."""

    rows: DataFrame
    quarantine: DataFrame
    verdicts: DataFrame


@dataclass(frozen=True)
class Scan:
    """All records of the accepted files, and all files.

    ``records``: file, block, pos (the place of the record), raw, values (array), columns (how many its file has).
    ``files``: file, lines, status, line_number, multi_line, bad_line, names (array; empty where there is no header).
    """

    records: DataFrame
    files: DataFrame
    lines: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.records.where(F.size("values") <= F.col("columns"))

    @property
    def quarantine(self) -> DataFrame:
        """Records with more fields than their file's header."""
        return self.records.where(F.size("values") > F.col("columns"))


def literal_path(file: str) -> str:
    """A URL-encoded file path as a reader takes it: decoded, and no character of it a wildcard."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def below(file: Column, root: Column) -> Column:
    """The decoded path of ``file`` below the folder ``root``, with or without a scheme in front."""
    decoded = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    folder = F.concat(F.rtrim(F.regexp_replace(root, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), F.lit("/")), F.lit("/"))
    at = F.instr(decoded, folder)
    return F.when(at > 0, F.substring(decoded, at + F.char_length(folder), F.lit(2**31 - 1))).otherwise(decoded)


def scan(spark: SparkSession, path: str | list[str]) -> Scan:
    """Every record of the CSV files below ``path`` as an array of its fields.

    The text is read once: its lines are written out with their places, so that check, header, rows and line numbers
    agree on them. Files that fail the structure check are left out. The table of files (verdict and column names) is
    written too, so that Spark knows its size: rows get their file's names by a broadcast where it is small, and by a join
    that splits hot files where it isn't. No layout adds a scan, and neither paths nor headers come to the driver.
    """
    target = scratch(spark, "upload")
    lines = csv_check.read_lines(spark, path).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    lines.write.parquet(f"{target}/lines", compression="zstd")
    lines = spark.read.schema(lines.schema).parquet(f"{target}/lines")
    whole = F.coalesce(F.col("header").rlike(csv_check.OUTSIDE_TO_OUTSIDE), F.lit(True))
    usable = (F.col("status") == "ok") & (F.col("lines") > 0)
    checked = csv_check.check_files(spark, path, lines).withColumn("whole", whole).withColumn("names", F.when(usable, csv_rows.names(F.col("header"))))
    checked.write.parquet(f"{target}/files")
    files = spark.read.schema(checked.schema).parquet(f"{target}/files")
    some = files.where(usable).agg(F.bool_or("multi_line"), F.bool_and("whole")).first()
    if some[1] is False:  # a header that goes on in the next line
        first = csv_rows.assembled(_of(lines, files.where(usable & ~F.col("whole")))).groupBy("file").agg(F.min_by("raw", F.struct("block", "pos")).alias("_long"))
        files = files.join(first, "file", "left").withColumn("names", F.coalesce(csv_rows.names(F.col("_long")), "names"))
    known = files.where(usable).select(F.col("file").alias("_of"), F.size("names").alias("columns"), "header_pos")
    records = lines.select("file", "block", "pos", F.col("line").alias("raw"))
    if some[0]:
        spread = csv_rows.assembled(_of(lines, files.where(usable & F.col("multi_line"))))
        records = _of(records, files.where(usable & ~F.col("multi_line"))).unionByName(spread)
    found = records.where(F.trim("raw") != "").join(known, F.col("file") == F.col("_of")).where((F.col("block") > 0) | (F.col("pos") != F.col("header_pos")))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return Scan(
        found.select("file", "block", "pos", "raw", csv_rows.fields(F.col("raw")).alias("values"), "columns"),
        files.select("file", "lines", "status", "line_number", "multi_line", "bad_line", names.alias("names")),
        lines,
    )


def _of(lines: DataFrame, files: DataFrame) -> DataFrame:
    return lines.join(files.select("file"), "file", "left_semi")


def by_name(found: Scan, columns: list[str]) -> DataFrame:
    """``columns``, ``_short`` and ``file`` of all kept records; NULL where a file has no column of that name (in any case)."""
    place = F.transform(F.array(*[F.lit(c.lower()) for c in columns]), lambda c: F.array_position(F.transform("names", F.lower), c).cast("int") - 1)
    return _placed(found, found.files.select("file", place.alias("_at")), columns)


def mapped(found: Scan, mapping: DataFrame, targets: list[str]) -> DataFrame:
    """``targets``, ``_short`` and ``file`` of all kept records, by ``mapping``: file, raw (a column's name), target.

    A target that a file maps no column to is NULL. Where a file maps two columns to one target, the first counts.
    """
    at = F.array_position(F.col("names"), F.col("raw")).cast("int") - 1
    pairs = found.files.select("file", "names").join(mapping.select("file", "raw", "target"), "file").withColumn("at", at).where("at >= 0")
    per_file = pairs.groupBy("file").agg(*[F.min(F.when(F.col("target") == t, F.col("at"))).alias(f"_{k}") for k, t in enumerate(targets)])
    return _placed(found, per_file.select("file", F.array(*[F.col(f"_{k}") for k in range(len(targets))]).alias("_at")), targets)


def _placed(found: Scan, places: DataFrame, columns: list[str]) -> DataFrame:
    """The values at each file's places; a place below 0, NULL or behind the end of a short record gives NULL."""
    joined = found.kept.join(places.withColumnRenamed("file", "_of"), F.col("file") == F.col("_of"))
    value = lambda k: F.when(F.get("_at", F.lit(k)) >= 0, F.get("values", F.get("_at", F.lit(k))))
    return joined.select(*(value(k).alias(c) for k, c in enumerate(columns)), (F.size("values") < F.col("columns")).alias("_short"), "file")


def column_names(found: Scan) -> list[str]:
    """Every column name of the files once, whatever its case; so many names come to the driver, not files or layouts."""
    each = found.files.select(F.posexplode("names").alias("at", "name"))
    known = each.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.min("at").alias("at"))
    return [r["name"] for r in known.orderBy("at", "key").collect()]


def uploads(found: Scan, company: Column, upload_id: Column) -> DataFrame:
    """One row per file as the list of uploads shows it; ``company`` and ``upload_id`` are expressions over ``file``.

    company_id, upload_id, file_name, storage_path, status, line_number, total_rows, short_rows, quarantined, columns.
    """
    wide = F.size("values") > F.col("columns")
    counts = found.records.groupBy("file").agg(
        F.count_if(~wide).alias("total_rows"), F.count_if(F.size("values") < F.col("columns")).alias("short_rows"), F.count_if(wide).alias("quarantined")
    )
    joined = found.files.join(counts, "file", "left").fillna(0, ["total_rows", "short_rows", "quarantined"])
    named = joined.select(company.alias("company_id"), upload_id.alias("upload_id"), base_name(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))).alias("file_name"), "*")
    path = csv_scan.storage_path(F.col("company_id"), F.col("upload_id"), F.col("file_name"))
    return named.select("company_id", "upload_id", "file_name", path.alias("storage_path"), "status", "line_number", "total_rows", "short_rows", "quarantined", F.col("names").alias("columns"))


def read(spark: SparkSession, path: str | list[str]) -> Upload:
    """Every row of the CSV files below ``path``: kept rows plus quarantine are the rows of the accepted files.

    Columns go by name whatever their order; a column that a file lacks is NULL in its rows.
    """
    found = scan(spark, path)
    rows = by_name(found, column_names(found)).withColumnRenamed("file", FILE)
    aside = found.quarantine.select("raw", F.size("values").alias("fields"), F.col("file").alias(FILE))
    return Upload(rows, aside, found.files.drop("names"))
