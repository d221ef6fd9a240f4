"""Language of a document as a mixture of languages.

Each language has a distribution over hashed letter trigrams. For one document, expectation-maximisation finds
the proportions of the languages that best explain its trigrams; languages are added in order of proportion as
long as the likelihood gains more than the penalty. The prediction is the language with the largest proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common

#: Trigrams are hashed into this many counters per language.
BUCKETS = 1 << 13
#: Added to each counter, so that an unseen trigram is unlikely but possible.
SMOOTHING = 0.5
#: Steps of expectation-maximisation, and the proportion below which a language isn't tried.
STEPS, LEAST = 12, 0.02
#: Log-likelihood that a further language has to gain, times log(trigrams) / 2. Trigrams overlap, hence over 1.
PENALTY = 6.0
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.arange(256, dtype=np.uint32)
_KEPT[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    likelihood: np.ndarray  # language x bucket

    def mixture(self, counts: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """The predicted language, its proportion, and the proportions of the chosen set."""
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(float), self.likelihood[:, at]
        order = np.argsort(-_proportions(p, n)[0], kind="stable")
        share = _proportions(p, n)[0][order]
        chosen, best = (order[:1], np.ones(1)), n @ np.log(p[order[0]])
        for k in range(2, len(order) + 1):
            if share[k - 1] < LEAST:
                break
            weights, value = _proportions(p[order[:k]], n)
            if value - best <= PENALTY * 0.5 * np.log(n.sum() + 1):
                break
            chosen, best = (order[:k], weights), value
        top = max(range(len(chosen[0])), key=lambda i: (chosen[1][i], -chosen[0][i]))
        found = {self.languages[j]: float(w) for j, w in zip(*chosen, strict=True)}
        return self.languages[chosen[0][top]], float(min(1.0, chosen[1][top])), found


def _proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    weights, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(STEPS):
        joint = weights @ p
        weights = weights * (p @ (n / joint)) / total
    return weights, float(n @ np.log(weights @ p))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed trigrams around each letter of the lower-cased whole text."""
    b = _KEPT[np.frombuffer(b" " + text.decode().lower().encode() + b" ", np.uint8)]
    codes = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[b[1:-1] != 32]
    return np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts over all rows for which ``learn`` holds and text and language are known.

    Each task counts its rows; the counts, a bounded table of languages x buckets, come to the driver. No such
    row: a model without languages, which predicts ``und`` for all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, "text"):
            for name, value in zip(batch.column("lang").to_pylist(), common.raw(batch, "text"), strict=True):
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += gram_counts(value)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "gram": at.astype(np.int32), "n": counts[at]})

    rows = (
        docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .mapInArrow(count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(counts, (np.searchsorted(languages, rows["lang"].to_numpy(str)), rows["gram"].to_numpy()), rows["n"].to_numpy())
    return Model([str(x) for x in languages], counts / counts.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares (a map of the chosen languages); a column so named is replaced.

    Null texts, texts without letters and all texts under a model without languages get ``und``, score 0 and an
    empty map. Equal texts get equal results; ties go to the language first in alphabetical order.
    """
    fields = {"lang_pred": "string", "score": "double", "lang_shares": "map<string,double>"}
    keep, schema = common.appended(docs, fields)
    if text not in keep:
        raise ValueError(f"the text column can't be named {text}")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            found = []
            for value in common.raw(batch, text):
                counts = gram_counts(value) if model.languages and _LETTER.search(value.decode()) else np.zeros(1)
                found.append(model.mixture(counts) if counts.any() else (UNKNOWN, 0.0, {}))
            lang, score, shares = zip(*found, strict=True)
            yield common.with_columns(batch, keep, {
                "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                "lang_shares": pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64())),
            })

    return docs.mapInArrow(predict, schema)
