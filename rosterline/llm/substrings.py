"""Removal of word windows that an earlier document has, with a count-min prefilter.

Documents lie in hashed groups. Each group sends the hashes of its windows, as sorted differences in a counter space
far larger than their number, to the shards of a sketch; a shard adds the counts of all groups. A counter never
underestimates, so only windows whose counter reaches two can be repeated, and only these are grouped exactly, by a
96-bit key, to find the smallest document of each. Answers return as one bit per question, in the order asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common, sketch

#: Words of a window.
WINDOW = 13

_LAST = np.iinfo(np.int64).max  # a null id comes after all others
_KEYS = "shard long, part long, keys binary, more binary, owners binary"


class _Group:
    """The windows of one group of documents, always in the same order."""

    def __init__(self, texts: pa.Table, size: int):
        self.size, self.slices, h, h2, doc = size, [], [], [], []
        for ids, found in common.unpacked(texts):
            data, begins = common.joined(found)
            starts, ends, of = common.words(data, begins)
            value = common.Hashes(data, 31).of(starts, ends)
            at = np.flatnonzero(of[size - 1 :] == of[: max(0, len(of) - size + 1)])
            owner = np.array([_LAST if i is None else i for i in ids], np.int64)
            h.append(common.runs_of(value, size, 32)[at])
            h2.append((common.runs_of(value, size, 33)[at] >> np.uint64(32)).astype(np.uint32))
            doc.append(owner[of[at]])
            self.slices.append((ids, found, of, at))
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.h, self.h2, self.doc = joined(h, np.uint64), joined(h2, np.uint32), joined(doc, np.int64)

    def counters(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counters in use, in order; how often each is used; the counter (by position) of each window."""
        counter, at, n = np.unique(self.h >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return counter, n, at

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the chosen windows, in order, in two parts; their smallest document; the key of each window."""
        order = np.lexsort((self.doc[chosen], self.h2[chosen], self.h[chosen]))
        h, h2, doc = self.h[chosen][order], self.h2[chosen][order], self.doc[chosen][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        return h[new], h2[new], doc[new], at


def first_seen(docs: DataFrame, text: str = "text", identifier: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space).

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on the
    input. Null and empty texts have no words; rows with the same id aren't smaller than each other; a null id is
    larger than any other. No row is left out.
    """
    packed, groups = common.grouped(docs, text, identifier)
    size = docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = sketch.bits_for(int(size))

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        return sketch.questions(key[0].as_py(), *_Group(texts, window).counters(bits)[:2], bits, groups)

    def ask_exactly(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        group = _Group(texts, window)
        counter, _, at = group.counters(bits)
        chosen = np.flatnonzero(sketch.answers(sketch.bit(known, "repeated"), sketch.bounds(counter, bits, groups))[at])
        h, h2, owner, _ = group.keys(chosen)
        bounds, out = sketch.bounds(h, 64, groups), []
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[s], bounds[s + 1])
            small = owner[own].min() >= 0 and owner[own].max() < 1 << 32
            out.append((s, key[0].as_py(), h[own].astype("<u8").tobytes(), h2[own].astype("<u4").tobytes(), owner[own].astype("<u4" if small else "<i8").tobytes()))
        return sketch.rows(out, _KEYS)

    def settle(key: tuple, asked: pa.Table) -> pa.Table:
        h, h2, owner, where = [], [], [], []
        for row in asked.to_pylist():
            h.append(np.frombuffer(row["keys"], "<u8"))
            h2.append(np.frombuffer(row["more"], "<u4"))
            owner.append(np.frombuffer(row["owners"], "<u4" if len(row["owners"]) == 4 * len(h[-1]) else "<i8").astype(np.int64))
            where.append(row["part"])
        cut = np.cumsum([len(x) for x in h])[:-1]
        h, h2, owner = np.concatenate(h), np.concatenate(h2), np.concatenate(owner)
        order = np.lexsort((owner, h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = owner[order][new][np.cumsum(new) - 1]
        earlier = np.zeros(len(h), bool)
        earlier[order] = least < owner[order]
        return sketch.rows([(part, key[0].as_py(), "earlier", np.packbits(x).tobytes()) for part, x in zip(where, np.split(earlier, cut), strict=True)], sketch.BITS)

    def remove(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        group = _Group(texts, window)
        counter, _, at = group.counters(bits)
        chosen = np.flatnonzero(sketch.answers(sketch.bit(known, "repeated"), sketch.bounds(counter, bits, groups))[at])
        h, _, owner, at = group.keys(chosen)
        earlier = sketch.answers(sketch.bit(known, "earlier"), sketch.bounds(h, 64, groups))
        gone = np.zeros(len(group.h), bool)
        gone[chosen] = earlier[at] | (owner[at] < group.doc[chosen])
        out, done = [], 0
        for ids, found, of, at in group.slices:
            marks = np.zeros(len(of) + 1, np.int64)
            hit = at[gone[done : done + len(at)]]
            done += len(at)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + window, -1)
            removed = np.cumsum(marks)[:-1] > 0
            n, lost = np.bincount(of, minlength=len(ids)), np.bincount(of, removed, len(ids)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            kept = []
            for k, value in enumerate(found):
                words = value.split()
                kept.append(b" ".join(words if not lost[k] else [w for w, r in zip(words, removed[first[k] : first[k + 1]], strict=True) if not r]).decode())
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(lost), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out)

    by = packed.groupBy("part")
    estimated = common.stored(by.applyInArrow(ask, sketch.ASKED).groupBy("shard").applyInArrow(sketch.estimate(2), sketch.BITS), "estimates")
    exact = by.cogroup(estimated.groupBy("part")).applyInArrow(ask_exactly, _KEYS).groupBy("shard").applyInArrow(settle, sketch.BITS)
    known = estimated.unionByName(exact)
    return by.cogroup(known.groupBy("part")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
