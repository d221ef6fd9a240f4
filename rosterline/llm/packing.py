"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most the sequence length. The counts of piece lengths, a bounded histogram,
give a plan: lengths are placed longest first, each into the packs with most room, as counts of packing patterns.
Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm import bpe, common

#: Tokens of a sequence; the id that ends each document.
SEQUENCE, END_ID = 1024, 0
#: Pieces that are ranked together.
RANKED = 100_000


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", identifier: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: full sequences, then the rest of the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(tokenizer)
        for batch in common.slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column("doc_id").to_pylist(), common.raw(batch, "text"), strict=True):
                ids = np.asarray([*codec.encode(value), END_ID], "<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    for column, x in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    named = docs.select(F.col(identifier).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (how many sequences, lengths in order).

    Each length adds at most two patterns (new packs, and a split of the packs that it doesn't fill), so there are
    at most twice as many patterns as lengths.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:
                open_packs[size - length].append((left, (length,)))
                break
            count, lengths = open_packs[room].pop()
            used = min(count, left)
            open_packs[room - length].append((used, (*lengths, length)))
            if used < count:
                open_packs[room].append((count - used, lengths))
            left -= used
    return [p for room in sorted(open_packs) for p in open_packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of each pattern: length, first and last rank, first sequence, copies in a sequence, offset."""
    out, ranks, sequence = [], defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            low = ranks[length]
            ranks[length] += copies * count
            out.append((length, low, ranks[length] - 1, sequence, copies, offset))
            offset += copies * length
        sequence += count
    return out


def packed(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``cut`` (see ``pieces``; read more than once) with sequence_id and offset.

    Ranks are counted in hashed groups of bounded size, so a length on most pieces is split. Equal rows take the
    places of their ranks in either order. No piece: no row.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(1, -(-sum(histogram.values()) // RANKED))
    named = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy("length", "_group").agg(F.count("*").alias("n")).select("length", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")
    ranked = named.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    table = cut.sparkSession.createDataFrame(slots(plan(histogram, size)) or [(0, 0, 0, 0, 1, 0)], "length long, low long, high long, first long, copies long, shift long")
    placed = ranked.join(F.broadcast(table), (ranked.length == table.length) & F.col("_rank").between(F.col("low"), F.col("high")))
    at = F.col("_rank") - F.col("low")
    return placed.select(
        "doc_id", "start", ranked.length, "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("shift") + (at % F.col("copies")) * ranked.length).cast("long").alias("offset"),
    )
