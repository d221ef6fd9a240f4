"""Regulated phrases in outreach text."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.operators.groups import with_all


@dataclass(frozen=True)
class Phrase:
    phrase: str
    violation: str
    severity: str
    ref: str
    suggestion: str


# The phrase list with its references and suggestions.
LEXICON = (
    Phrase(
        "superior outcomes", "Off-Label", "High", "FDA 21 CFR 201.57(c)(2)",
        "statistically significant improvement in primary endpoints",
    ),
    Phrase(
        "novel ARNI therapy", "Off-Label", "Medium", "FDA Guidance: Drug Promotional Labeling",
        "approved ARNI therapy",
    ),
    Phrase(
        "PIONEER-HF trial", "Sunshine Act", "Low", "42 CFR Part 403",
        "Note: disclosure may be required for materials referencing manufacturer-sponsored trials.",
    ),
    Phrase(
        "new Phase III data", "State Restriction", "High", "CA Health & Safety Code 119402",
        "Published Phase III data (citation required)",
    ),
)


def _literal(phrase: Phrase) -> Column:
    return F.struct(*[F.lit(x).alias(f.name) for f, x in zip(fields(Phrase), astuple(phrase))])


def scan(df: DataFrame, text: str, keys: list[str], lexicon: tuple[Phrase, ...] = LEXICON) -> DataFrame:
    """One row per text and contained phrase, in any case: ``keys`` and the phrase's columns.

    The phrases are a reviewed list in code, so they travel inside the expression; no join is needed
    and texts without a phrase produce nothing.
    """
    lowered = df.select(*keys, F.lower(F.col(text)).alias("_text"))
    hits = [F.when(F.col("_text").contains(p.phrase.lower()), _literal(p)) for p in lexicon]
    return lowered.select(*keys, F.inline(F.array_compact(F.array(*hits))))


def counts(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: open High flags, resolved flags and whether all High flags are resolved."""
    is_open = F.col("status") == "open"
    high = F.col("severity") == "High"
    return flags.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("flags"),
        F.count_if(high & is_open).alias("high_open"),
        F.count_if(~is_open).alias("resolved"),
        F.coalesce(F.every(~high | ~is_open), F.lit(True)).alias("all_high_resolved"),
    )


def campaign_gate(flags: DataFrame, by: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Whether campaign assets may be exported, with the reason if not.

    ``groups`` has all values of ``by``, null being one; one without flags is available.
    """
    n = F.col("high_open")
    reason = F.concat(
        F.lit("Export blocked: "),
        n.cast("string"),
        F.when(n > 1, " High-severity flags").otherwise(" High-severity flag"),
        F.lit(" must be resolved before exporting campaign assets."),
    )
    counted = counts(flags, by)
    if groups is not None:
        counted = with_all(counted, groups, by).fillna(0, ["high_open"]).fillna({"all_high_resolved": True})
    return counted.select(
        *(by or []), F.col("all_high_resolved").alias("available"), F.when(n > 0, reason).alias("block_reason")
    )
