"""Rows of CSV files of any layout from their lines, by the strict grammar; the plan is the same for any number of layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.sources.csv_check import (
    FIELD,
    INSIDE_TO_INSIDE,
    INSIDE_TO_OUTSIDE,
    OUTSIDE_TO_INSIDE,
    OUTSIDE_TO_OUTSIDE,
)


def fields(line: Column) -> Column:
    """The fields of a well-formed record as an array; a field without quotes and characters is NULL."""

    def value(field: Column) -> Column:
        inner = F.substring(field, F.lit(2), F.char_length(field) - 2)
        return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(field != "", field)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({FIELD})"), F.lit(1)), value)


def names(header: Column) -> Column:
    """Column names of a header: unnamed ones by their place, names that come again (in any case) with their place behind."""
    given = fields(header)

    def name(x: Column, i: Column) -> Column:
        again = F.size(F.filter(given, lambda y: F.lower(y) == F.lower(x))) > 1
        return F.when(x.isNull() | (x == ""), F.concat(F.lit("_c"), i)).when(again, F.concat(x, i)).otherwise(x)

    return F.transform(given, name)


def assembled(lines: DataFrame) -> DataFrame:
    """``file, block, pos, raw``: the records of files whose quoted fields span lines, at the place of their first line.

    A line that is well-formed from one state only shows the state before it; between such lines, those that turn the
    state are counted. One task reads a file's lines in order, as these files can't be split.
    """
    line = F.col("line")
    outside = F.when(line.rlike(OUTSIDE_TO_OUTSIDE), 0).when(line.rlike(OUTSIDE_TO_INSIDE), 1)
    inside = F.when(line.rlike(INSIDE_TO_INSIDE), 1).when(line.rlike(INSIDE_TO_OUTSIDE), 0)
    order = Window.partitionBy("file").orderBy("block", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # The state after the line where it doesn't depend on the one before: only one outcome is well-formed, or both agree.
    known = F.when(F.col("o").isNull(), F.col("i")).when(F.col("i").isNull() | (F.col("o") == F.col("i")), F.col("o"))
    turns = F.coalesce((F.col("o") == 1) & (F.col("i") == 0), F.lit(False)).cast("int")
    marked = lines.withColumns({"o": outside, "i": inside}).withColumn("turned", F.sum(turns).over(order))
    since = F.last((known + F.col("turned")) % 2, ignorenulls=True).over(before)
    state = (F.coalesce(since, F.lit(0)) + F.coalesce(F.lag("turned").over(order), F.lit(0))) % 2
    starts = marked.withColumn("state", state).withColumn("record", F.sum(F.when(F.col("state") == 0, 1).otherwise(0)).over(order))
    gathered = starts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "line"))).alias("parts"))
    return gathered.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["pos"].alias("pos"), F.array_join(F.col("parts.line"), "\n").alias("raw"))


def located(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` (with the file, block and pos of a line) and the line's number in its file, from 1, as ``row``.

    Lines are counted per input split, and the splits of a file added up; only ``rows`` and these counts are joined.
    """
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    blocks = counts.select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), shift)
    joined = rows.join(blocks, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    return joined.withColumn("row", F.col("pos") + F.col("shift")).drop("of_file", "of_block", "shift")


