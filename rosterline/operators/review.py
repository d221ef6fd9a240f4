"""Review decisions on flags and their effect on records.

``resolutions`` is append-only: ``flag_id, action, ts, seq`` and optional ``master, note,
justification``. The latest row of a flag counts; ``undo`` reopens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.functions.validators import normalize
from rosterline.operators.groups import with_all

# Fixed value: shortest justification that makes an override of a provider number count, and the category of these.
MIN_JUSTIFICATION = 15
OVERRIDE_CATEGORY = "npi_validation"
NO_NOTE = "No note provided"


def latest(resolutions: DataFrame, key: str = "flag_id") -> DataFrame:
    """Current decision per flag: a maximum, combined before the shuffle (sorted by flag, since it holds text)."""
    payload = [c for c in resolutions.columns if c not in (key, "ts", "seq")]
    newest = F.max(F.struct("ts", "seq", *payload)).alias("newest")
    current = resolutions.groupBy(key).agg(newest)
    return current.select(key, *[f"newest.{c}" for c in ("ts", "seq", *payload)]).where("action <> 'undo'")


def accepted_overrides(resolutions: DataFrame, flags: DataFrame, key: str = "flag_id") -> DataFrame:
    """Decisions on ``flags`` without overrides of provider numbers that lack a sufficient justification.

    They go before the latest decision is found, so an earlier one stays in force. Overrides of other
    categories need no justification.
    """
    long_enough = F.char_length(F.coalesce("justification", F.lit(""))) >= MIN_JUSTIFICATION
    category = F.coalesce(F.lower("_category"), F.lit(""))
    known = resolutions.join(flags.select(key, F.col("category").alias("_category")), key)
    accepted = (F.col("action") != "override") | (category != OVERRIDE_CATEGORY) | long_enough
    return known.where(accepted).select(*resolutions.columns)


def with_decision(flags: DataFrame, decisions: DataFrame, key: str = "flag_id") -> DataFrame:
    """Every flag with its decision, if any; ``resolved`` tells whether there is one.

    Both sides hold one row per flag, so no key can be hot.
    """
    return flags.join(decisions, key, "left").withColumn("resolved", F.col("action").isNotNull())


def open_flags(flags: DataFrame) -> DataFrame:
    return flags.where(~F.coalesce("resolved", F.lit(False)))


def open_counts(flags: DataFrame, keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Flags in total, resolved and still open per group; open never falls below zero.

    ``groups`` has all values of ``keys``, null being one; one without flags has zeros.
    """
    counted = flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved"))
    if groups is not None:
        counted = with_all(counted, groups, keys).fillna(0, ["total", "resolved"])
    return (
        counted.withColumn("open", F.greatest(F.lit(0), F.col("total") - F.col("resolved")))
    )


def drop_removed(records: DataFrame, decided: DataFrame, key: str = "record_id") -> DataFrame:
    """Records without those that a decision ``removed``."""
    removed = decided.where("action = 'removed'").select(key).distinct()
    return records.join(removed, key, "left_anti")


def anonymize(records: DataFrame, decided: DataFrame, columns: list[str], key: str = "record_id") -> DataFrame:
    """SHA-256 in place of every value whose flag was ``anonymized``; ``field`` names the column."""
    hidden = (
        decided.where("action = 'anonymized'").groupBy(key).agg(F.collect_set("field").alias("_hidden"))
    )
    joined = records.join(hidden, key, "left")
    return joined.select(
        *[
            F.when(F.array_contains("_hidden", c), F.sha2(F.col(c), 256)).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in records.columns
        ]
    )


def quality_warnings(decided: DataFrame) -> DataFrame:
    """Flags kept with a data-quality warning, with their note."""
    note = F.when(normalize(F.col("note")) == "", NO_NOTE).otherwise(F.col("note"))
    return decided.where("action = 'warned'").withColumn("note", note)


def tag_warnings(records: DataFrame, warned: DataFrame, key: str = "record_id") -> DataFrame:
    """Clean records and, for each warning, its record tagged with ``dq_flag`` and ``dq_note``.

    ``records`` has one row per key and is read once. A record's warnings are streamed past it, however many.
    """
    notes = warned.select(key, F.lit("[DATA QUALITY WARNING]").alias("dq_flag"), F.col("note").alias("dq_note"))
    return records.join(notes, key, "left").fillna("", ["dq_flag"])


def surviving_records(records: DataFrame, pairs: DataFrame, key: str = "record_id") -> DataFrame:
    """Records left after duplicate decisions.

    ``pairs`` holds ``rec1, rec2, action, master``: a merge keeps the chosen record, a removal keeps
    the chosen record or else the first, distinct keeps both, and an open pair changes nothing.
    """
    keeps_second = F.coalesce(F.col("master") == 2, F.lit(False))
    loser = F.when(keeps_second, F.col("rec1")).otherwise(F.col("rec2"))
    losers = pairs.where("action IN ('merged', 'removed')").select(loser.alias(key)).distinct()
    return records.join(losers, key, "left_anti")
