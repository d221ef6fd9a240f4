"""Documents drawn so that their words are distributed like those of a target collection.

A word's bucket is the CRC of its bytes. Distinct words of equal length form one matrix of bytes, whose CRCs are
updated column by column, and the buckets are scattered back to the words. Two histograms of buckets, of all documents
and of the target, give a gain per bucket; a document's weight is the mean gain of its words. Weights with Gumbel noise
from the document's id make the highest scores a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm import common, terms

BUCKETS = 10_000
#: Longer words are few for their bytes; they don't form a matrix.
LONGEST = 256

_LETTER = terms.word_bytes((0x30, 0x39), (0x61, 0x7A))
#: The reflected polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(_POLYNOMIAL), state >> 1)
    return state


_TABLE = _crc_table()


def crcs(words: pa.LargeBinaryArray) -> np.ndarray:
    """CRC-32 of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    length = np.diff(offsets)
    out = np.zeros(len(words), np.uint32)
    order = np.argsort(length, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        size = int(length[at[0]]) if len(at) else 0
        if size > LONGEST:
            out[at] = [zlib.crc32(data[offsets[k] : offsets[k + 1]]) for k in at.tolist()]
            continue
        matrix = data[offsets[at][:, None] + np.arange(size)]
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            state = _TABLE[(state ^ column) & 255] ^ state >> 8
        out[at] = ~state
    return out


def features(texts: list[bytes], least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every feature."""
    found = terms.words(texts, _LETTER, least, most)
    return (crcs(found.distinct) % buckets).astype(np.int64)[found.code], found.doc


def histogram(docs: DataFrame, text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task adds up its own; the driver gets one number per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in common.slices(batches, "text", terms.SLICE_BYTES):
            n += np.bincount(features(common.raw(batch, "text"), least, most, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(everywhere: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target than in all documents, both smoothed by one."""
    n, size, wanted = len(everywhere), float(everywhere.sum()), float(target.sum())
    pairs = zip(everywhere.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (size + n) / ((s + 1.0) * (wanted + n)))) for s, t in pairs], np.int64)


def _noise(seed: int, identifier: Column) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 over ``seed:id``; a null id is an empty text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gain: np.ndarray, text: str, identifier: str, least: int, most: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", terms.SLICE_BYTES):
            texts = common.raw(batch, "text")
            bucket, doc = features(texts, least, most, buckets)
            n = np.bincount(doc, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, doc, gain[bucket])
            only = n if (least, most) == (1, 1) else np.bincount(terms.words(texts, _LETTER).doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(only), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"]
            )

    named = docs.select(F.col(identifier).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least: int = 1, most: int = 1, least_words: int = 20,
    buckets: int = BUCKETS, text: str = "text", identifier: str = "doc_id",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the rank of those that aren't drawn is null.

    Drawn is this share (rounded down) of the documents with at least ``least_words`` words, by score, ties to smaller
    ids, null ids last. A null or empty text has no features and weight 0. Rows with one id share its noise, each row
    has its own rank. Empty tables: no rows; an empty target: all of its counts are 0. Other columns take no part.
    """
    gain = gains(histogram(docs, text, least, most, buckets), histogram(target, text, least, most, buckets))
    scored = weights(docs, gain, text, identifier, least, most).withColumn("score", F.col("weight") + _noise(seed, F.col("doc_id")))
    # Equal rows are one with a count, so that no group of rows, however often repeated, is one task's to sort.
    scored = common.stored(scored.groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("copies")), "scores")
    long_enough = F.col("n_words") >= least_words
    # One row per score, a whole number within some 60,000 of 0: so much at most comes to the driver.
    tally = scored.filter(long_enough).groupBy("score").agg(F.sum("copies").alias("n")).orderBy(F.desc("score")).toArrow()
    n = tally.column("n").to_numpy().astype(np.int64)
    drawn = int(n.sum()) * percent // 100
    above = np.cumsum(n) - n
    places = pa.table({"score": tally.column("score"), "above": pa.array(above)}).filter(pa.array(above < drawn))
    cut = places.column("score")[-1].as_py() if places.num_rows else None
    in_reach = long_enough & (F.col("score") >= cut) if cut is not None else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    places = docs.sparkSession.createDataFrame(places.cast(pa.schema([("score", pa.int64()), ("above", pa.int64())])))
    reached = scored.filter(in_reach).withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(F.broadcast(places), "score")
    ranked = reached.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("rank", F.col("above") + F.col("before") + F.col("k"))
    rest = scored.filter(~in_reach).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")]
    return ranked.select(*columns).unionByName(rest.select(*columns))
