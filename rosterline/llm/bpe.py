"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts texts where their content says so, so equal passages of different documents
give equal chunks. A chunk that occurs more than once in the corpus is encoded once, by one of its documents, and
its ids are sent to the others. Where two encoded pieces meet, a window around the join is encoded again and grown
until both its edges are token boundaries of the pieces, which makes the result exactly that of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterline.llm import common

#: The rolling hash looks at so many bytes, and cuts at one of so many positions.
LOOK_BACK, ONE_IN = 24, 1024
#: Bytes of text that are encoded in one task group.
GROUP_BYTES = 8 << 20

#: Split pattern of the byte-level pre-tokenizer: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Character classes of later characters depend on the Unicode version of a library.
_LATER = re.compile("[^\x00-ɏ]")
#: The pre-tokenizer always splits before a single space between letters, and what follows doesn't depend on what is before.
_SAFE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


class Codec:
    """The ids that the tokenizers library gives for a byte-level BPE file, without added special tokens.

    Texts of the first 592 characters of Unicode go through tiktoken with the same vocabulary, which is several
    times faster; others, and files of another kind, go through the tokenizers library itself.
    """

    _known: dict[str, Codec] = {}

    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_letters()
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        vocabulary = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.table = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in vocabulary.items():
            self.table[i] = bytes(letters[c] for c in token) if self.plain else token.encode()
        for token, i in special.items():
            self.table[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.table), np.int64, len(self.table))
        if self.plain:
            ranks = {self.table[i]: i for i in vocabulary.values()}
            self.fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            self.special = [s.encode() for s in special]

    @classmethod
    def of(cls, content: str) -> Codec:
        """One codec per worker and file."""
        key = hashlib.sha256(content.encode()).hexdigest()
        if key not in cls._known:
            cls._known[key] = cls(content)
        return cls._known[key]

    def encode(self, text: bytes) -> list[int]:
        s = text.decode()
        if not self.plain or _LATER.search(s):
            return self.library.encode(s, add_special_tokens=False).ids
        if any(x in text for x in self.special):
            return self.fast.encode(s, allowed_special="all")
        return self.fast.encode_ordinary(s)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        if not self.plain:
            return self.library.decode([int(i) for i in ids], skip_special_tokens=False)
        return b"".join([self.table[i] for i in ids]).decode(errors="replace")

    def repaired(self, text: bytes, pieces: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Ids of the whole text from pieces (start, ids) that follow each other."""
        if len(pieces) == 1:
            return pieces[0][1]
        ids = np.concatenate([p for _, p in pieces])
        edges = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        windows: list[list[int]] = []
        safe = [m.start() for m in _SAFE.finditer(text)]
        for cut, _ in pieces[1:]:
            k = int(np.searchsorted(safe, cut))
            if k < len(safe) and safe[k] == cut:
                continue
            low, high = k - 1, k
            while low >= 0 and not _is_edge(edges, safe[low]):
                low -= 1
            while high < len(safe) and not _is_edge(edges, safe[high]):
                high += 1
            window = [safe[low] if low >= 0 else 0, safe[high] if high < len(safe) else len(text)]
            if windows and window[0] <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], window[1])
            else:
                windows.append(window)
        parts, at = [], 0
        for low, high in windows:
            i, j = np.searchsorted(edges, (low, high))
            parts += [ids[at:i], np.asarray(self.encode(text[low:high]), np.uint32)]
            at = j
        return np.concatenate([*parts, ids[at:]]).astype(np.uint32)


def _is_edge(edges: np.ndarray, at: int) -> bool:
    return bool(edges[np.searchsorted(edges, at)] == at)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> str:
    """The tokenizer file, read on the driver (its size is that of a vocabulary) and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunks(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and 128-bit hash (two values) of the chunks of joined texts; an empty text has none."""
    hashes, other = common.Hashes(data, 21), common.Hashes(data, 22)
    at = np.arange(LOOK_BACK, len(data))
    rolling = hashes.of(at - LOOK_BACK, at)
    cuts = at[(rolling % np.uint64(ONE_IN) == 0) & ((data[at] & 0xC0) != 0x80)]
    ends = begins[1:] - 1
    starts = np.unique(np.concatenate([begins[:-1], cuts]))
    doc = np.searchsorted(begins, starts, "right") - 1
    stops = np.minimum(np.append(starts[1:], len(data)), ends[doc])
    filled = stops > starts
    starts, stops, doc = starts[filled], stops[filled], doc[filled]
    return starts, stops, doc, hashes.of(starts, stops).view(np.int64), other.of(starts, stops).view(np.int64)


_KEYS = "h1 long, h2 long, part long"


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every row; null and empty texts have no ids.

    Rows with equal or null ids are rows of their own. ``tokenizer`` is the content of the file (see ``load``).
    """
    code = "doc_id long, ids array<int>, decoded string"

    def rows(codec: Codec, ids: list[int | None], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())),
            pa.array([codec.decode(x) for x in found], pa.string()),
        ], ["doc_id", "ids", "decoded"])

    return _encoded(docs, tokenizer, text, identifier, rows, code)


def digests(docs: DataFrame, tokenizer: str, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    code = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def rows(codec: Codec, ids: list[int | None], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
            pa.array([sha(",".join(map(str, x.tolist())).encode()) for x in found], pa.string()),
            pa.array([sha(codec.decode(x.tolist()).encode()) for x in found], pa.string()),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, tokenizer, text, identifier, rows, code)


def _encoded(docs, tokenizer, text, identifier, rows, schema):  # noqa: ANN001, ANN202
    groups = common.parts(docs, F.octet_length(F.col(text)) + 1, GROUP_BYTES)
    named = docs.select(
        F.pmod(F.xxhash64(F.col(identifier), F.col(text)), F.lit(groups)).alias("part"), F.col(identifier).cast("long").alias("doc_id"), F.col(text).alias("text")
    )

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            _, _, doc, h1, h2 = chunks(*common.joined(common.raw(batch, "text")))
            part = np.asarray(batch.column("part"))[doc]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(part)], ["h1", "h2", "part"])

    uses = common.stored(named.mapInArrow(list_chunks, _KEYS).groupBy("h1", "h2", "part").agg(F.count("*").alias("n")), "bpe-chunks")
    # A chunk on a third of all rows has one row per group here, not one per document.
    shared = uses.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("part").alias("part")).filter("n > 1").drop("n")

    packed = named.mapInArrow(common.pack, "part long, doc_id long, text binary")

    def encode_shared(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        codec, found = Codec.of(tokenizer), {}
        left = set(zip(wanted.column("h1").to_pylist(), wanted.column("h2").to_pylist(), strict=True))
        for batch in common.unpacked(texts) if left else ():
            data, begins = common.joined(batch[1])
            content = data.tobytes()
            for low, high, _, *h in zip(*(x.tolist() for x in chunks(data, begins)), strict=True):
                if (h := tuple(h)) in left:
                    left.discard(h)
                    found[h] = np.asarray(codec.encode(content[low:high]), "<u4").tobytes()
        h1, h2 = zip(*found, strict=True) if found else ((), ())
        return pa.table({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "ids": pa.array(found.values(), pa.binary())})

    once = packed.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(encode_shared, "h1 long, h2 long, ids binary")
    sent = once.join(uses.select("h1", "h2", "part"), ["h1", "h2"])

    def encode_rest(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        codec = Codec.of(tokenizer)
        have = {
            (a, b): np.frombuffer(c, "<u4")
            for a, b, c in zip(*(known.column(k).to_pylist() for k in ("h1", "h2", "ids")), strict=True)
        }
        out = []
        for ids, batch in common.unpacked(texts):
            found = _with_known(codec, batch, have)
            out += rows(codec, ids, found)
        return pa.Table.from_batches(out)

    return packed.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(encode_rest, schema)


def _with_known(codec: Codec, texts: list[bytes], have: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
    data, begins = common.joined(texts)
    pieces: list[list] = [[] for _ in texts]  # per text: start, end, ids if known
    for low, high, doc, *h in zip(*(x.tolist() for x in chunks(data, begins)), strict=True):
        known, base, own = have.get(tuple(h)), int(begins[doc]), pieces[doc]
        if known is None and own and own[-1][2] is None:
            own[-1][1] = high - base
        else:
            own.append([low - base, high - base, known])
    out = []
    for text, own in zip(texts, pieces, strict=True):
        full = [(a, np.asarray(codec.encode(text[a:b]), np.uint32) if ids is None else ids) for a, b, ids in own]
        out.append(codec.repaired(text, full) if full else np.zeros(0, np.uint32))
    return out
