"""Small text and time helpers, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the white space that separates words. Plain characters are taken first, in one run.
WORD_PATTERN = (
    r"(?:[!-~]++|[^\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}])++"
)


def first_filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is UTC, unreadable text is NULL."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def moment(df: DataFrame, column: str, text: str) -> Column:
    """A fixed point in time in the type of a column, so that a comparison can reach the scan."""
    return F.lit(text).cast(df.schema[column].dataType)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda part: F.left(part, F.lit(1))), "")


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def clean_list_file_name(source_file: Column, day: Column) -> Column:
    """``HCP_Clean_<source without extension>_<yyyy-MM-dd>.csv``; without a source ``Export``."""
    base = F.coalesce(F.regexp_replace(source_file, r"\..+$", ""), F.lit("Export"))
    return F.concat(F.lit("HCP_Clean_"), base, F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv"))


def replace_phrases(text: Column, replacements: dict[str, str]) -> Column:
    """Put each accepted suggestion in place of its phrase, which is found in any case as the scan finds it."""

    def put(out: Column, pair: tuple[str, str]) -> Column:
        literal = pair[1].replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(out, F.lit("(?iu)" + re.escape(pair[0])), F.lit(literal))

    return reduce(put, replacements.items(), text)


def _any_of(phrases: list[str]) -> str:
    """Any of the phrases, in any case; of several that begin at one place the longest."""
    return "(?iu)(?:" + "|".join(map(re.escape, sorted(phrases, key=lambda p: (-len(p), p)))) + ")"


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Array of ``phrase, start, stop`` (from 0, characters) of all hits, found in one pass from left to right.

    Hits don't overlap: one that begins inside an earlier one doesn't count.
    """
    pattern = _any_of(phrases)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<phrase:string,start:int,stop:int>>").alias("hits"))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["before"])
        end = begin + F.char_length(pair["hit"])
        hit = F.struct(_named(pair["hit"], phrases).alias("phrase"), begin.alias("start"), end.alias("stop"))
        return F.struct(end.alias("at"), F.array_append(acc["hits"], hit).alias("hits"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, h: F.struct(b.alias("before"), h.alias("hit")))
    return F.aggregate(pairs, start, add, lambda acc: acc["hits"])


def _named(hit: Column, phrases: list[str]) -> Column:
    """The phrase that a hit is, as the list spells it."""
    return F.coalesce(*[F.when(F.lower(hit) == p.lower(), F.lit(p)) for p in phrases], hit)


def replace_accepted(text: Column, replacements: dict[str, str], accepted: Column) -> Column:
    """The text with suggestions in place of those hits whose phrase is in the array ``accepted``; other hits stay as
    they are written. Hits are those of :func:`phrase_hits`, and what is put in isn't searched again."""
    pattern = _any_of(list(replacements))
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def put(hit: Column) -> Column:
        chosen = F.array_contains(accepted, _named(hit, list(replacements)))
        suggested = F.coalesce(*[F.when(F.lower(hit) == p.lower(), F.lit(s)) for p, s in replacements.items()], hit)
        return F.when(F.coalesce(chosen, F.lit(False)), suggested).otherwise(hit)

    parts = F.zip_with(between, found, lambda b, h: F.concat(b, F.coalesce(put(h), F.lit(""))))
    return F.array_join(parts, "")
