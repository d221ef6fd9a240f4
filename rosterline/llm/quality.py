"""Quality score of a document by regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its whole text. Each class has a mean and a covariance,
shrunk towards the pooled covariance and towards a multiple of the identity. The score is the probability of the
good class from the difference of the two log densities, by Mahalanobis distances with cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common

#: Weight of the pooled covariance in each class covariance, and of the identity after that.
POOLED, IDENTITY = 0.1, 0.02
#: A document is good from this score on.
THRESHOLD = 0.7

FEATURES = (
    "length upper digit symbol space wide word_length word_spread distinct repeated top_word bare_words "
    "marked_words line_length repeated_lines short_words upper_words"
).split()

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 space, 6 part of a wider character
_KIND[33:127] = 4
_KIND[48:58] = 3
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[[32, *range(9, 14)]] = 5
_KIND[128:] = 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The logit of a proportion, drawn in so that 0 and 1 stay finite and short texts vary little."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5)) - np.log1p(1 / (whole + 1))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has a row too."""
    n = len(texts)
    data, begins = common.joined(texts)
    kind = _KIND[data]
    size = np.diff(begins) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), begins[:-1])

    upper, digit, symbol, wide = (per_text(kind == k) for k in (1, 3, 4, 6))
    space = per_text(kind == 5) - 1  # without the line end put after each text
    starts, ends, doc = common.words(data, begins)
    length = (ends - starts).astype(float)
    hashes = common.Hashes(data, 11)
    value = hashes.of(starts, ends)

    def per_word(weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, n) if len(doc) else np.zeros(n)

    count = per_word()
    mean = per_word(length) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(per_word(length**2) / np.maximum(count, 1) - mean**2, 0))
    again = np.zeros(len(doc), bool)
    again[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = _groups(value, doc, n)
    letters = np.concatenate([[0], np.cumsum(np.isin(kind, (1, 2, 6)))])
    capital = np.concatenate([[0], np.cumsum(kind == 1)])
    in_word = letters[ends] - letters[starts]
    last = kind[ends - 1]
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    filled = line_ends > line_starts
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = np.searchsorted(begins, line_starts, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines, _ = _groups(hashes.of(line_starts, line_ends), line_doc, n)
    return np.stack([
        np.log1p(size), _share(upper, size), _share(digit, size), _share(symbol, size), _share(space, size), _share(wide, size),
        np.log1p(mean), np.log1p(spread), _share(distinct, count), _share(per_word(again), count), _share(top, count),
        _share(per_word(in_word == 0), count), _share(per_word(last == 4), count), np.log1p(size / np.maximum(lines, 1)),
        _share(lines - distinct_lines, lines), _share(per_word(length < 3), count),
        _share(per_word((capital[ends] - capital[starts]) * 2 > in_word), count),
    ], axis=1)


def _groups(value: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and how often the most frequent one occurs."""
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(at, append=len(v)).astype(float))
    return np.bincount(d[at], minlength=n).astype(float), top


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1; None where a class is missing."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]] | None
    fallback: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.fallback)
        z = (x - self.centre) / self.scale
        log_density = []
        for prior, mean, inverse, log_det in self.classes:
            y = (z - mean) @ inverse.T
            log_density.append(prior - 0.5 * (y * y).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def train(labelled: DataFrame, text: str = "text", quality: str = "quality") -> Model:
    """Fit on all rows with a quality of 0 or 1.

    Each task sums its vectors and their products; what comes to the driver is one bounded row per class and
    task group, added up there. Without rows of both classes every score is the share of class 1 (0.5 without any).
    """
    statistics = with_features(labelled.select(F.col(text).alias("text"), F.col(quality).alias("quality")), "text")
    return fit(statistics, "quality")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the vector ``statistics``."""
    keep, schema = common.appended(docs, {text: "string", "statistics": "array<double>"})
    schema = schema.replace(f"`{text}` string, ", "")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            x = features(common.raw(batch, text))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield common.with_columns(batch, keep, {"statistics": pa.ListArray.from_arrays(offsets, x.ravel())})

    return docs.mapInArrow(measure, schema)


def fit(rows: DataFrame, quality: str = "quality") -> Model:
    """The model of rows that have ``statistics`` and a label."""
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("statistics").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("quality"))
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "v": sums.ravel()})

    found = (
        rows.filter(F.col(quality).isin(0, 1))
        .select("statistics", F.col(quality).cast("int").alias("quality"))
        .mapInArrow(moments, "at int, v double")
        .groupBy("at")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    sums = np.zeros(2 * (1 + d + d * d))
    sums[found["at"].to_numpy(int)] = found["v"].to_numpy(float)
    sums = sums.reshape(2, -1)
    n, s, q = sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d)
    if min(n) < 2:
        return Model(np.zeros(d), np.ones(d), None, float(n[1] / n.sum()) if n.sum() else 0.5)
    centre = s.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(q.sum(axis=0)) / n.sum() - centre**2, 1e-6))
    means = (s / n[:, None] - centre) / scale
    spreads = [(q[k] / n[k] - np.outer(s[k], s[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (spreads[0] * n[0] + spreads[1] * n[1]) / n.sum()
    classes = []
    for k in (0, 1):
        c = (1 - POOLED) * spreads[k] + POOLED * pooled
        c = (1 - IDENTITY) * c + IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(c)
        classes.append((float(np.log(n[k] / n.sum())), means[k], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Model(centre, scale, classes, 0.5)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on); a column so named is replaced. Null texts count as empty."""
    keep, schema = common.appended(docs, {"score": "double", "predicted": "int"})
    if text not in keep:
        raise ValueError(f"the text column can't be named {text}")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            s = model.score(features(common.raw(batch, text)))
            yield common.with_columns(batch, keep, {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return docs.mapInArrow(rate, schema)
