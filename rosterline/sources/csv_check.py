"""Strict structural check of CSV files, without reading a file in one piece.

A line changes the reader's state (outside or inside a quoted field) in a way that depends on the line
alone, so every line is turned into its two possible outcomes in parallel, runs of lines are composed
into one step each, and only those steps are put in order per file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reader states after a line.
OUTSIDE, INSIDE, FAULT = 0, 1, 2

# Lines per run; a run's quoted lines are gathered in one array, so this bounds its size.
RUN_LINES = 1 << 16

# Bytes of a file whose splits become one step at each level of the tree. An array has at most the 1,024 splits of 4 MB in
# 4 GB, and a file one entry per 4 GB; levels above, each over 1,024 of those below, are for single files of many TB.
LEVELS = (1 << 32,)

# Grammar of the format: quoted content, one field, and the four ways a line can be well-formed.
CONTENT = r'[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(?:"{CONTENT}"|[^",][^,]*+|)'
OUTSIDE_TO_OUTSIDE = rf"^{FIELD}(?:,{FIELD})*+$"
OUTSIDE_TO_INSIDE = rf'^(?:{FIELD},)*+"{CONTENT}$'
INSIDE_TO_OUTSIDE = rf'^{CONTENT}"(?:,{FIELD})*+$'
INSIDE_TO_INSIDE = rf'^{CONTENT}(?:",(?:{FIELD},)*+"{CONTENT})?$'


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as ``file, block, pos, line``.

    ``pos`` grows by one per line within a block (one input split); it is only meaningful there.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def _outcomes(line: Column) -> tuple[Column, Column]:
    from_outside = (
        F.when(line.rlike(OUTSIDE_TO_OUTSIDE), OUTSIDE).when(line.rlike(OUTSIDE_TO_INSIDE), INSIDE).otherwise(FAULT)
    )
    from_inside = (
        F.when(line.rlike(INSIDE_TO_INSIDE), INSIDE).when(line.rlike(INSIDE_TO_OUTSIDE), OUTSIDE).otherwise(FAULT)
    )
    return from_outside, from_inside


def _follow(state: Column, step: Column) -> Column:
    """State after ``step``, which has one outcome per starting state; a fault stays a fault."""
    return F.when(state == OUTSIDE, step["outside"]).when(state == INSIDE, step["inside"]).otherwise(FAULT)


def _outcome(state: Column, at: Column, multi: Column) -> Column:
    return F.struct(state.alias("state"), at.cast("long").alias("at"), multi.alias("multi"))


def _run(lines: Column, first_pos: Column, start: int) -> Column:
    """What a run of ordered lines does from one start state: end state, line of the fault within the
    run if any, and whether a quoted field went over a line end."""

    def step(acc: Column, line: Column) -> Column:
        state = _follow(acc["state"], line)
        fault = F.when((state == FAULT) & acc["at"].isNull(), line["pos"] - first_pos + 1).otherwise(acc["at"])
        return _outcome(state, fault, acc["multi"] | (state == INSIDE))

    return F.aggregate(lines, _outcome(F.lit(start), F.lit(None), F.lit(start == INSIDE)), step)


def _chain(steps: Column, start: int) -> Column:
    """What consecutive steps do together from one start state; ``lines`` counts all their lines."""
    begin = F.struct(
        F.lit(start).alias("state"),
        F.lit(None).cast("long").alias("at"),
        F.lit(start == INSIDE).alias("multi"),
        F.lit(0).cast("long").alias("lines"),
        F.lit(None).cast("long").alias("bad"),
    )

    def advance(acc: Column, s: Column) -> Column:
        taken = F.when(acc["state"] == INSIDE, s["from_inside"]).otherwise(s["from_outside"])
        done = acc["state"] == FAULT
        return F.struct(
            F.when(done, FAULT).otherwise(taken["state"]).alias("state"),
            F.when(done, acc["at"]).otherwise(acc["lines"] + taken["at"]).alias("at"),
            (acc["multi"] | (~done & taken["multi"])).alias("multi"),
            (acc["lines"] + s["n"]).alias("lines"),
            F.coalesce(acc["bad"], acc["lines"] + s["bad"]).alias("bad"),
        )

    return F.aggregate(steps, begin, advance)


def _composed(steps: DataFrame, by: list[str], place: str, *starts: int) -> DataFrame:
    """The consecutive steps of each group, in the order of ``place``, as one: ``by``, ``head`` and the step's fields."""
    fields = F.struct(place, "n", "bad", "from_outside", "from_inside")
    gathered = steps.groupBy(*by).agg(F.min_by("head", place).alias("head"), F.array_sort(F.collect_list(fields)).alias("steps"))
    chained = gathered.select(*by, "head", *(_chain(F.col("steps"), x).alias(f"s{x}") for x in starts))
    ends = [_outcome(F.col(f"s{x}.state"), F.col(f"s{x}.at"), F.col(f"s{x}.multi")).alias(name) for x, name in zip(starts, ("from_outside", "from_inside"))]
    return chained.select(*by, "head", F.col(f"s{starts[0]}.lines").alias("n"), F.col(f"s{starts[0]}.bad").alias("bad"), *ends)


def structure_faults(lines: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Verdict per file: ``file, lines, status, line_number, multi_line, bad_line, header, header_pos``.

    ``status`` is ``ok``, ``invalid_utf8`` (reported at line 1), ``stray_text`` behind a closing quote
    (at its line) or ``unclosed_quote`` (at the last line). ``multi_line`` tells whether a quoted field
    spans lines, which is what a reader must know to split the file or not. ``bad_line`` is the first line
    with bytes that aren't UTF-8, ``header`` and ``header_pos`` are the first line of the file and its ``pos``.

    Lines become runs of at most 65,536, the runs of an input split one step, and neighbouring splits one step at
    each level of a tree, so that no array grows with the file. The levels need no further shuffle; there can be none
    where no file is longer than the first.
    """
    line = F.col("line")
    from_outside, from_inside = _outcomes(line)
    quoted = F.when(
        line.contains('"'), F.struct("pos", from_outside.alias("outside"), from_inside.alias("inside"))
    )
    runs = (
        lines.withColumn("run", F.floor(F.col("pos") / RUN_LINES))
        .groupBy("file", "block", "run")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("pos").alias("first_pos"),
            F.min(F.when(~F.call_function("is_valid_utf8", line), F.col("pos"))).alias("bad_pos"),
            F.min_by(F.struct("line", "pos"), "pos").alias("head"),
            F.array_sort(F.collect_list(quoted)).alias("quoted"),
        )
        .select(
            "file",
            "block",
            "run",
            "n",
            "head",
            (F.col("bad_pos") - F.col("first_pos") + 1).alias("bad"),
            _run(F.col("quoted"), F.col("first_pos"), OUTSIDE).alias("from_outside"),
            _run(F.col("quoted"), F.col("first_pos"), INSIDE).alias("from_inside"),
        )
    )
    steps = _composed(runs, ["file", "block"], "run", OUTSIDE, INSIDE).repartition("file")
    for covered in levels:
        steps = steps.withColumn("part", F.floor(F.col("block") / covered) * covered)
        steps = _composed(steps, ["file", "part"], "block", OUTSIDE, INSIDE).withColumnRenamed("part", "block")
    ended = _composed(steps, ["file"], "block", OUTSIDE)
    end = F.col("from_outside")
    status = (
        F.when(F.col("bad").isNotNull(), "invalid_utf8")
        .when(end["state"] == FAULT, "stray_text")
        .when(end["state"] == INSIDE, "unclosed_quote")
        .otherwise("ok")
    )
    line_number = (
        F.when(F.col("bad").isNotNull(), F.lit(1).cast("long"))
        .when(end["state"] == FAULT, end["at"])
        .when(end["state"] == INSIDE, F.col("n"))
    )
    return ended.select(
        "file",
        F.col("n").alias("lines"),
        status.alias("status"),
        line_number.alias("line_number"),
        end["multi"].alias("multi_line"),
        F.col("bad").alias("bad_line"),
        F.col("head.line").alias("header"),
        F.col("head.pos").alias("header_pos"),
    )


def check_files(spark: SparkSession, path: str | list[str], lines: DataFrame | None = None) -> DataFrame:
    """Verdict per CSV file below ``path``, an empty one ``ok`` with no lines. Only names ending in ``.csv`` are checked.

    ``lines`` are those of the files where they were read already.
    """
    # a scan leaves empty files out; the names come from the listing that the reader holds anyway
    files = spark.createDataFrame([(plain(f),) for f in spark.read.text(path).inputFiles()], "file string")
    levels = LEVELS
    if lines is None:
        lines = read_lines(spark, path).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    elif (lines.agg(F.max("block")).first()[0] or 0) < LEVELS[0]:
        levels = ()
    is_csv = F.lower("file").endswith(".csv")
    return files.where(is_csv).join(structure_faults(lines.where(is_csv), levels), "file", "left").select(
        "file",
        F.coalesce("lines", F.lit(0).cast("long")).alias("lines"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        "line_number",
        F.coalesce("multi_line", F.lit(False)).alias("multi_line"),
        "bad_line",
        "header",
        "header_pos",
    )


def plain(file: str) -> str:
    """A file's path with one form of the local scheme."""
    return re.sub("^file:/+", "file:/", file)
