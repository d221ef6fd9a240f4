"""Removal of byte strings that occur elsewhere, by merging Burrows-Wheeler transforms of shards.

Every 200-byte window is assigned to the smallest of its 24-byte grams by hash, its anchor; equal windows have equal
anchors at equal places. Neighbouring windows with one anchor form a run, and the text of a run is its context. Runs
whose anchor occurs once (by a count-min sketch) can't repeat and end here.

The contexts are dealt by anchor into buckets and there into shards. With all contexts aligned at their anchors, the
suffixes that start in one column are kept in order; the transform of a shard is, column by column from the right, the
bytes of the column in the order of the suffixes that follow them. Transforms are merged by refining an interleave
of shard numbers: in each round every shard's next bytes are dealt out along the interleave, and a stable counting
sort by byte gives the interleave one column to the left. No suffix is sorted again. Neighbours in the merged order
with a common prefix of 200 bytes are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common, sketch

#: Bytes of a repeated string, and of the gram that anchors it.
LENGTH, GRAM = 200, 24
#: Bytes of text per bucket, and shards whose transforms are merged in a bucket.
BUCKET_BYTES, SHARDS = 16 << 20, 4
#: Runs that share an anchor before they are dealt by what blocks of BLOCK windows have in common besides.
MANY, BLOCK = 20_000, 8

_CONTEXTS = "bucket long, shard int, part long, blob binary"
_TRANSFORM = "bucket long, shard int, blob binary"


class _Group:
    """The runs of one group of documents, always in the same order."""

    def __init__(self, texts: pa.Table, length: int, gram: int):
        self.length, self.gram = length, gram
        self.slices = []
        anchors = []
        for ids, found in common.unpacked(texts):
            data, begins = common.joined(found)
            runs, anchor = self._runs(data, begins)
            self.slices.append((ids, data, begins, runs))
            anchors.append(anchor)
        self.anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)

    def _runs(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window, number of windows and anchor position of each run; the hash of each anchor."""
        n = len(data) - self.length + 1
        if n <= 0:
            return np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(data) - self.gram + 1)
        hashes = common.Hashes(data, 41).of(at, at + self.gram)
        least = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        reach, span = 1, self.length - self.gram + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: n], least[span - reach : span - reach + n])
        place = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = begins[1:] - 1
        starts = np.arange(n)
        doc = np.searchsorted(begins, starts, "right") - 1
        inside = np.flatnonzero(starts + self.length <= ends[doc])
        new = np.ones(len(inside), bool)
        new[1:] = (place[inside[1:]] != place[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        s = inside[first]
        # Anchors are small hashes; mixed again they spread over all counters and buckets.
        return np.stack([s, np.diff(first, append=len(inside)), place[s]], axis=1), common.mix(hashes[place[s]])

    def counters(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counter, at, n = np.unique(self.anchor >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return counter, n, at

    def requests(self, repeated: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        """The runs to look at, those with frequent anchors split into blocks, in the order of their keys.

        slice, start, windows, place; key; which distinct context each is (numbered in key order), and how many share it.
        """
        out: dict[str, list] = {k: [] for k in ("slice", "start", "windows", "place", "key", "a", "b")}
        done = 0
        for k, (_, data, _, runs) in enumerate(self.slices):
            own = slice(done, done + len(runs))
            done += len(runs)
            chosen, anchor, split = runs[repeated[own]], self.anchor[own][repeated[own]], many[own][repeated[own]]
            whole = chosen[~split]
            s, n, p, key = [whole[:, 0]], [whole[:, 1]], [whole[:, 2]], [anchor[~split]]
            hashes, other = common.Hashes(data, 42), common.Hashes(data, 43)
            if split.any():
                first, count, place = chosen[split].T
                top, low = (place - first) // BLOCK, (place - first - count + 1) // BLOCK
                each = top - low + 1
                i = np.repeat(np.arange(len(first)), each)
                block = top[i] - (np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each))
                start = np.maximum(first[i], place[i] - block * BLOCK - BLOCK + 1)
                stop = np.minimum(first[i] + count[i], place[i] - block * BLOCK + 1)
                inner = place[i] - block * BLOCK
                common_part = hashes.of(inner, inner - BLOCK + 1 + self.length)
                s.append(start)
                n.append(stop - start)
                p.append(place[i])
                key.append(common.mix(anchor[split][i] ^ common.mix(common_part + block.astype(np.uint64))))
            s, n, p, key = map(np.concatenate, (s, n, p, key))
            end = s + n - 1 + self.length
            for name, x in zip(out, (np.full(len(s), k), s, n, p, key, hashes.of(s, end), other.of(s, end) + (p - s).astype(np.uint64)), strict=True):
                out[name].append(x)
        kinds = {"key": np.uint64, "a": np.uint64, "b": np.uint64}
        found = {name: np.concatenate(x) if x else np.zeros(0, kinds.get(name, np.int64)) for name, x in out.items()}
        order = np.lexsort((found["b"], found["a"], found["key"]))
        found = {name: x[order] for name, x in found.items()}
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([found[x][1:] != found[x][:-1] for x in ("key", "a", "b")], axis=0)
        found["context"] = np.cumsum(new) - 1
        found["distinct"] = np.flatnonzero(new)
        found["shared"] = np.bincount(found["context"])[found["context"]] if len(order) else found["context"]
        return found


def _zip(**arrays: np.ndarray) -> bytes:
    head = np.array([x for a in arrays.values() for x in (len(a),)], "<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class _Columns:
    """Contexts aligned at their anchors; suffixes become active from their last column to their first."""

    def __init__(self, lead: np.ndarray, windows: np.ndarray, length: int, gram: int):
        self.length = length
        self.left, self.width = length - gram, 2 * length - gram
        self.first = self.left - lead
        self.windows = windows
        self.end = self.first + windows - 1 + length
        ends = np.argsort(self.end, kind="stable")
        self.edges = np.searchsorted(self.end[ends], np.arange(self.width + 2))
        self.ends = ends

    def active(self, order: np.ndarray, column: int) -> np.ndarray:
        """Suffixes with a byte in the column, in the order of what follows it: those that end here come first."""
        new = self.ends[self.edges[column + 1] : self.edges[column + 2]]
        return np.concatenate([new, order[self.first[order] <= column]])


def transform(lead: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The Burrows-Wheeler transform of contexts (their bytes one after the other), columns from right to left."""
    c = _Columns(lead, windows, length, gram)
    table = np.zeros((len(lead), c.width), np.uint8)
    table[(np.arange(c.width) >= c.first[:, None]) & (np.arange(c.width) < c.end[:, None])] = data
    order, out = np.zeros(0, np.int64), []
    for column in range(c.width - 1, -1, -1):
        order = c.active(order, column)
        bytes_ = table[order, column]
        out.append(bytes_)
        order = order[np.argsort(bytes_, kind="stable")]
    return np.concatenate(out)


def merge(shard: np.ndarray, lead: np.ndarray, windows: np.ndarray, transforms: list[np.ndarray], length: int, gram: int) -> np.ndarray:
    """Which windows of which context are repeated in another context: contexts x windows.

    ``shard``, ``lead`` and ``windows`` describe the contexts, sorted by shard; ``transforms`` has one per shard.
    """
    c = _Columns(lead, windows, length, gram)
    table = np.zeros((len(lead), c.width), np.uint8)
    repeated = np.zeros((len(lead), c.left + 1), bool)
    shard = shard.astype(np.uint8)
    order, used = np.zeros(0, np.int64), np.zeros(len(transforms), np.int64)
    for column in range(c.width - 1, -1, -1):
        order = c.active(order, column)
        interleave = shard[order]
        counts = np.bincount(interleave, minlength=len(transforms))
        bytes_ = np.empty(len(order), np.uint8)
        bytes_[np.argsort(interleave, kind="stable")] = np.concatenate([t[u : u + n] for t, u, n in zip(transforms, used, counts, strict=True)])
        used += counts
        table[order, column] = bytes_
        order = order[np.argsort(bytes_, kind="stable")]
        if column > c.left:
            continue
        here = order[column < c.first[order] + windows[order]]
        a, b = here[:-1], here[1:]
        for low, high in ((0, 16), (16, length)):
            same = (table[a, column + low : column + high] == table[b, column + low : column + high]).all(axis=1) if len(a) else np.zeros(0, bool)
            a, b = a[same], b[same]
        repeated[a, column - c.first[a]] = True
        repeated[b, column - c.first[b]] = True
    return repeated


def _flags(repeated: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The flags of each context's own windows, one after the other."""
    return repeated[np.arange(repeated.shape[1]) < windows[:, None]]


def repeats_removed(docs: DataFrame, text: str = "text", identifier: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes), kept (binary): every occurrence of a repeated string goes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another, overlaps included; judged on the input. Null is empty; shorter texts stay whole; rows with equal or
    null ids are texts of their own; a repeated row is a repetition. No row is left out.
    """
    packed, groups = common.grouped(docs, text, identifier)
    size = int(docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)
    bits, buckets = sketch.bits_for(size), max(1, -(-size // BUCKET_BYTES))

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        common.release()
        return sketch.questions(key[0].as_py(), *_Group(texts, length, gram).counters(bits)[:2], bits, groups)

    def requests(texts: pa.Table, known: pa.Table) -> tuple[_Group, dict[str, np.ndarray], np.ndarray]:
        group = _Group(texts, length, gram)
        counter, _, at = group.counters(bits)
        edges = sketch.bounds(counter, bits, groups)
        found = group.requests(*(sketch.answers(sketch.bit(known, kind), edges)[at] for kind in ("repeated", "many")))
        return group, found, sketch.bounds(found["key"][found["distinct"]], 64, buckets)

    def extract(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        common.release()
        group, found, edges = requests(texts, known)
        part, out = key[0].as_py(), []
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            chosen = found["distinct"][edges[bucket] : edges[bucket + 1]]
            s, n, p, k = (found[x][chosen] for x in ("start", "windows", "place", "slice"))
            data = b"".join(group.slices[j][1][a : a + w - 1 + length].tobytes() for j, a, w in zip(k.tolist(), s.tolist(), n.tolist(), strict=True))
            out.append((bucket, part % SHARDS, part, _zip(lead=(p - s).astype("<i4"), windows=n.astype("<i4"), data=np.frombuffer(data, np.uint8))))
        return sketch.rows(out, _CONTEXTS)

    def build(key: tuple, contexts: pa.Table) -> pa.Table:
        common.release()
        parts, found = [], []
        for part, blob in sorted(zip(contexts.column("part").to_pylist(), contexts.column("blob").to_pylist(), strict=True)):
            found.append(_unzip(blob, "<i4", "<i4", "u1"))
            parts.append((part, len(found[-1][0])))
        lead, windows, data = (np.concatenate(x) for x in zip(*found, strict=True))
        blob = _zip(parts=np.array(parts, "<i8").ravel(), lead=lead, windows=windows, bwt=transform(lead.astype(np.int64), windows.astype(np.int64), data, length, gram))
        return sketch.rows([(key[0].as_py(), key[1].as_py(), blob)], _TRANSFORM)

    def combine(key: tuple, transforms: pa.Table) -> pa.Table:
        common.release()
        found = [_unzip(b, "<i8", "<i4", "<i4", "u1") for b in transforms.column("blob").to_pylist()]
        lead, windows = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (1, 2))
        shard = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
        repeated = merge(shard, lead, windows, [f[3] for f in found], length, gram)
        at, out = 0, []
        for part, n in np.concatenate([f[0] for f in found]).reshape(-1, 2).tolist():
            out.append((part, key[0].as_py(), "windows", np.packbits(_flags(repeated[at : at + n], windows[at : at + n])).tobytes()))
            at += n
        return sketch.rows(out, sketch.BITS)

    def remove(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        common.release()
        group, found, edges = requests(texts, known)
        answers = sketch.bit(known, "windows")
        windows = found["windows"][found["distinct"]]
        flags = np.zeros(int(windows.sum()), bool)
        ends = np.concatenate([[0], np.cumsum(windows)])
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            low, high = ends[edges[bucket]], ends[edges[bucket + 1]]
            flags[low:high] = answers[bucket][: high - low]
        out = []
        for k, (ids, data, begins, _) in enumerate(group.slices):
            own = np.flatnonzero(found["slice"] == k)
            n, context = found["windows"][own], found["context"][own]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = flags[np.repeat(ends[context], n) + step] | np.repeat(found["shared"][own] > 1, n)
            start = (np.repeat(found["start"][own], n) + step)[hit]
            marks = np.zeros(len(data) + 1, np.int64)
            np.add.at(marks, start, 1)
            np.add.at(marks, start + length, -1)
            gone = np.cumsum(marks)[:-1] > 0
            change = np.diff(gone.view(np.int8), prepend=0)
            low, high = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            doc = np.searchsorted(begins, low, "right") - 1
            spans: list[list] = [[] for _ in ids]
            for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist(), strict=True):
                spans[d].append({"start": a - int(begins[d]), "end": b - int(begins[d])})
            kept = [data[a:b][~gone[a:b]].tobytes() if spans[d] else data[a:b].tobytes() for d, (a, b) in enumerate(zip(begins[:-1], begins[1:] - 1, strict=True))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(begins) - 1), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]))
        return pa.Table.from_batches(out)

    by = packed.groupBy("part")
    estimated = common.stored(by.applyInArrow(ask, sketch.ASKED).groupBy("shard").applyInArrow(sketch.estimate(2, MANY), sketch.BITS), "estimates")
    contexts = by.cogroup(estimated.groupBy("part")).applyInArrow(extract, _CONTEXTS)
    transforms = contexts.groupBy("bucket", "shard").applyInArrow(build, _TRANSFORM)
    known = estimated.unionByName(transforms.groupBy("bucket").applyInArrow(combine, sketch.BITS))
    return by.cogroup(known.groupBy("part")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def as_text(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept_text of the result of ``repeats_removed``: a character that was cut in two goes whole."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([b.decode(errors="ignore") for b in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), kept], ["doc_id", "n_bytes", "kept_text"])

    return found.select("doc_id", "n_bytes", "kept").mapInArrow(decode, "doc_id long, n_bytes long, kept_text string")
