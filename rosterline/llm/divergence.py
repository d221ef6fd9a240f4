"""How far the word use of the sources of each language lies apart.

A language keeps the terms of enough of its documents. Each group (language, source) has a smoothed probability of
every kept term, in whole billionths. The sum of differences of two groups over all kept terms is found by a cube of
tasks: a cell is a block of groups, another block of groups and a block of terms. It gets the slices of both blocks,
computes all partial sums of its pairs at once, and the partial sums of a pair are added along the axis of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm import common, terms

#: Groups and terms along the edges of a cell: two dense slices of 256 x 512 numbers, at most 65,536 pairs.
GROUPS, TERMS = 256, 512
#: A probability is counted in parts of this; what is added to every count.
UNIT, ADDED = 1_000_000_000, 5

_LETTER = terms.word_bytes((0x61, 0x7A))
_CELL = ["lang", "low", "high", "term_block"]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); nulls are ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", terms.SLICE_BYTES):
            found = terms.words(common.raw(batch, "text"), _LETTER)
            size = max(1, len(found.distinct))
            named, group = _groups(batch)
            in_doc, n = np.unique(found.doc * size + found.code, return_counts=True)
            key, where = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(key // size)) for c in named),
                    terms.as_strings(found.distinct).take(pa.array(key % size)),
                    pa.array(np.bincount(where, n, len(key)).astype(np.int64)),
                    pa.array(np.bincount(where, minlength=len(key))),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    counted = _named(docs, lang, source, F.col(text).alias("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame, lang: str, source: str, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))), *more)


def _groups(batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray]:
    """lang and source of each group of the batch, and the group of each row."""
    parts = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (p.indices.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts)
    size = max(1, len(parts[1].dictionary))
    codes, group = np.unique(lang * size + source, return_inverse=True)
    return [parts[0].dictionary.take(pa.array(codes // size)), parts[1].dictionary.take(pa.array(codes % size))], group


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)), in decimals, so that no count is too large."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    below = (total + ADDED * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, F.when(kept > 0, below))).otherwise(F.lit(1)).cast("long")


def divergence(
    docs: DataFrame, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language by the sum of absolute differences over all kept terms. Part
    ``term``: the ``top`` kept terms of the group by how much likelier it uses them than its language as a whole.
    Null text, lang and source are '' (a group and a language like others). A group without terms has the smoothed
    probabilities; a language without kept terms has pairs of value 0. Ties go to the smaller item as UTF-8. Repeated
    rows count each time. Other columns take no part, whatever their names. An empty table gives no rows.
    """
    counts = common.stored(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    held = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    held = common.stored(held.withColumn("term_hash", F.xxhash64("term")), "kept-counts")
    kept = common.stored(held.groupBy("lang", "term", "term_hash").agg(F.first("in_lang").alias("in_lang")), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs, lang, source).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    groups = groups.join(sizes, "lang").withColumns({
        "group_blocks": F.ceil(F.col("groups") / GROUPS),
        "term_blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)),
        "absent": _probability(F.lit(0), F.col("total"), F.col("kept")),
    })
    groups = common.stored(groups.withColumn("block", F.pmod(F.xxhash64("source"), "group_blocks")), "groups")
    held = held.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("n"), F.col("total"), F.col("kept")))
    return _pairs(groups, kept, held).unionByName(_distinctive(held, top))


def _distinctive(held: DataFrame, top: int) -> DataFrame:
    q = _probability(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    found = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    return _ranked(found).filter(F.col("rank") <= top)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def _pairs(groups: DataFrame, kept: DataFrame, held: DataFrame) -> DataFrame:
    term_block = F.pmod(F.col("term_hash"), "term_blocks").alias("term_block")
    langs = groups.select("lang", "term_blocks").distinct()
    per_block = kept.join(langs, "lang").select("lang", term_block).groupBy("lang", "term_block").agg(F.count("*").alias("terms"))
    edge = groups.withColumn("term_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))).join(per_block, ["lang", "term_block"], "left")
    columns = ["lang", "block", "group_blocks", "term_block", "source"]
    # A group's own row in each block of terms says what absent terms get there, and how many terms the block has.
    own = edge.select(*columns, F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), F.coalesce("terms", F.lit(0)).alias("terms"))
    entries = held.withColumn("term_block", term_block).select(*columns, "term", "p", F.lit(0).cast("long").alias("terms"))
    rows = own.unionByName(entries).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)))
    cells = rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term_block", "block", "source", "term", "p", "terms")
    partial = cells.groupBy(*_CELL).applyInArrow(cell, "lang string, a string, b string, value long")
    total = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = total.select("lang", ends.alias("e"), "value")
    return _ranked(both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value"))


def cell(rows: pa.Table) -> pa.Table:
    """lang, a, b, value: the partial sums of all pairs of one cell."""
    rows = rows.combine_chunks()
    own = rows.filter(pc.is_null(rows.column("term")))
    entries = rows.filter(pc.is_valid(rows.column("term")))
    sources, block, absent = own.column("source"), own.column("block").to_numpy(), own.column("p").to_numpy()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    term = entries.column("term").combine_chunks().dictionary_encode()
    width = len(term.dictionary)
    dense = np.repeat(absent[:, None], width, axis=1)
    at = pc.index_in(entries.column("source"), value_set=sources.combine_chunks()).to_numpy()
    dense[at, term.indices.to_numpy(zero_copy_only=False)] = entries.column("p").to_numpy()
    # Terms of the block that none of these groups has are alike for all: one product instead of columns.
    nowhere = own.column("terms")[0].as_py() - width
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if low == high else right
        value = np.abs(dense[others] - dense[i]).sum(axis=1) + nowhere * np.abs(absent[others] - absent[i])
        pairs.append((np.full(len(others), i), others, value))
    i, j, value = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
    a, b = sources.take(pa.array(i)), sources.take(pa.array(j))
    swap = pc.greater(pc.cast(a, pa.binary()), pc.cast(b, pa.binary()))
    a, b = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
    lang = pa.repeat(rows.column("lang")[0], len(value))
    return pa.table({"lang": lang, "a": a, "b": b, "value": pa.array(value.astype(np.int64))})
