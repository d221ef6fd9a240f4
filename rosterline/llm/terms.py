"""Distinct words of many texts at a time, each as a code into a dictionary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rosterline.llm import common

#: Bytes of text whose words share a dictionary.
SLICE_BYTES = 1 << 21


def word_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes belong to words: the ranges, both ends included, and all bytes of wider characters."""
    letter = np.zeros(256, bool)
    letter[128:] = True
    for low, high in ranges:
        letter[low : high + 1] = True
    return letter


@dataclass(frozen=True)
class Words:
    """Every word of the texts: its code in ``distinct`` and the number of its text, in order."""

    distinct: pa.LargeBinaryArray
    code: np.ndarray
    doc: np.ndarray


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte runs, copied one after another."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])


def words(texts: list[bytes], letter: np.ndarray, least: int = 1, most: int = 1) -> Words:
    """Words are runs of bytes that are ``letter`` once A-Z are lower-cased; with ``most`` over 1 also runs of several
    words of one text, joined by one space (least to most of them, all shorter runs first)."""
    data, begins = common.joined(texts)
    data = common.lower_ascii(data)
    change = np.diff(letter[data].view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    doc = np.searchsorted(begins, starts, "right") - 1
    if most > 1:
        data = _spaced(data, starts, ends)
        ends = np.cumsum(ends - starts + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    found = []
    for n in range(least, most + 1):
        first = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
        found.append((starts[first], ends[first + n - 1], doc[first]))
    starts, ends, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    named = runs(data, starts, ends).dictionary_encode()
    return Words(named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc)


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words with one space after each."""
    letters = np.frombuffer(runs(data, starts, ends).buffers()[2] or b"", np.uint8)
    return np.insert(letters, np.cumsum(ends - starts), 32)


def as_strings(distinct: pa.LargeBinaryArray) -> pa.Array:
    return pc.cast(pc.cast(distinct, pa.large_string()), pa.string())
