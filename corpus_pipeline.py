"""Preparation of a training corpus from the documents table, stage by stage.

Each stage takes the rows its predecessor kept and returns those that it keeps; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import common, language, minhash, packing, quality, queries, suffixes

#: A document is rejected if its language is unknown or explains less than this share of it; one in three languages passes.
LEAST_LANGUAGE = 0.25


def _apart(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text, whatever their names) and ``text``, so that an operator's columns replace none."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), "text")


def _whole(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language. Trained on the rows of this input that aren't held out."""
    common.ship(spark)
    found = language.identify(_apart(docs), queries.language_model(docs))
    return _whole(found.filter((found.lang_pred != language.UNKNOWN) & (found.score >= LEAST_LANGUAGE)), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality."""
    common.ship(spark)
    model = queries.quality_model(docs, common.table(spark, sf_dir, "labels"))
    return _whole(quality.score(_apart(docs), model).filter("predicted = 1"), docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on 5-word shingles; those without words are no one's duplicate.

    Documents are told apart by all their columns: null ids and ids that several documents have are no reason to go.
    """
    common.ship(spark)
    return minhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings; one of which nothing is left goes. A character cut in two goes whole.

    Texts return to their rows by a hash of all columns, so null and repeated ids are as good as others.
    """
    common.ship(spark)
    row, size, kept = (common.unused(docs, c) for c in ("_row", "_bytes", "_text"))
    keyed = docs.select("*", common.row_keys(docs)[0].alias(row), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias(size))
    found = suffixes.as_text(suffixes.repeats_removed(keyed, identifier=row))
    left = found.filter((F.octet_length("kept_text") > 0) | (F.col("n_bytes") == 0))
    left = left.select(F.col("doc_id").alias(row), F.col("n_bytes").alias(size), F.col("kept_text").alias(kept)).dropDuplicates([row, size])
    fresh = keyed.drop("text", "n_chars").join(left, [row, size])
    text = F.col(kept)
    return fresh.select(*(text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    common.ship(spark)
    return packing.packed(common.stored(packing.pieces(docs, queries.tokenizer()), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("sequence_packing", sequence_packing),
]

#: Trained models can't be expressed in SQL. The tests hold the stages on near duplicates and repeated strings against
#: brute force, and all stages to their rules on awkward columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
