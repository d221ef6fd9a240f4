"""Helpers shared by the operators of this folder: table access, slices of text, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline import runtime

#: Bytes of text in a group of documents that is handled together.
GROUP_BYTES = 8 << 20
#: Bytes of text that a task turns into arrays at a time. A single longer text is taken whole.
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def ship(spark: SparkSession) -> None:
    """Let Spark carry this package to the Python workers, once per application; they may not share the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_rosterline_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp()  # on the driver alone, which serves the file until it ends
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(archive := f"{folder}/rosterline.zip", "w") as z:
        for path in sorted((root / "rosterline").rglob("*.py")):
            z.write(path, str(path.relative_to(root)))
    sc.addPyFile(archive)
    sc._rosterline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return runtime.table(spark, sf_dir, name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, every reader sees the same rows."""
    spark = df.sparkSession
    path = runtime.scratch(spark, label)
    df.write.parquet(f"{path}/table", compression="zstd")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def remainder(identifier: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string").cast("binary")) % divisor, F.lit(-1))


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns, row_a and row_b: rows with equal keys are equal, null ids and repeated ids or not."""
    columns = [_hashable(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType) for f in df.schema.fields]
    each = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(k), *each).alias(name) for k, name in enumerate(("row_a", "row_b"))]


def _hashable(column: Column, kind: T.DataType) -> Column:
    """A map as its entries in order, anything else that holds a map as JSON; Spark hashes neither as they are."""
    if isinstance(kind, T.MapType) and "map<" not in kind.keyType.simpleString() + kind.valueType.simpleString():
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column)) if "map<" in kind.simpleString() else column


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores behind, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(df: DataFrame, size: Column, target: int) -> int:
    """How many groups of about ``target`` the rows fill; a count over all rows, no upper limit."""
    total = df.select(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // target))


def grouped(docs: DataFrame, text: str, identifier: str) -> tuple[DataFrame, int]:
    """part, doc_id, text (compressed) in hashed groups of about GROUP_BYTES, and how many groups there are.

    The text is part of the hash, so that rows without an id, or with one and the same, don't share a group.
    """
    groups = parts(docs, F.octet_length(F.col(text)) + 1, GROUP_BYTES)
    named = docs.select(
        F.pmod(F.xxhash64(F.col(identifier), F.col(text)), F.lit(groups)).alias("part"), F.col(identifier).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    return named.mapInArrow(pack, "part long, doc_id long, text binary"), groups


def release() -> None:
    """Give memory that a finished group has freed back to the machine; a worker lives through many groups."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has this call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(low, high - low)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a line end, and where each begins (one entry more than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes other than white space."""
    letter = ~_SEPARATOR[data]
    change = np.diff(letter.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return starts, ends, np.searchsorted(begins, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint8)
    table_[65:91] += 32
    return table_[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (invertible, so distinct values stay distinct)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: An odd base, the same for all seeds, so that a worker keeps two tables of powers.
_BASE = 0x2545F4914F6CDD1D
_tables: dict[int, np.ndarray] = {}


@lru_cache(32)
def _numbers(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 257, np.uint64)


def powers(base: int, size: int) -> np.ndarray:
    """The first powers of the base modulo 2^64; a table that was too short is made anew, and a very long one isn't kept."""
    known = _tables.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, SLICE_BYTES + (SLICE_BYTES >> 2)), base, np.uint64)
        known[0] = 1
        np.cumprod(known, dtype=np.uint64, out=known)
        if len(known) <= 4 * SLICE_BYTES:
            _tables[base] = known
    return known[:size]


#: Sums of powers modulo 2^64 have collisions that can be written down from 1024 bytes on; runs over this length, which are
#: few for their bytes, get a hash of their own besides.
LONG_RUN = 400


class Hashes:
    """64-bit hashes of any byte runs of one array, from prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        self.data, self.key = data, seed.to_bytes(8, "little")
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = _numbers(seed)[data]
        terms *= powers(_BASE, len(data))
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(pow(_BASE, -1, 1 << 64), len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        long = np.flatnonzero(ends - starts > LONG_RUN)
        if len(long):
            pairs = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
            digests = b"".join(hashlib.blake2b(self.data[a:b], digest_size=8, key=self.key).digest() for a, b in pairs)
            h[long] ^= np.frombuffer(digests, np.uint64)
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_of(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values (of word hashes, say)."""
    n = max(0, len(values) - size + 1)
    base = _numbers(seed)[256] | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * base + values[i : i + n]
    return mix(out)


def appended(df: DataFrame, fields: dict[str, str]) -> tuple[list[str], str]:
    """Columns of ``df`` that stay beside new ones (a column of the same name in any case is replaced), and the schema."""
    taken = {name.lower() for name in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    quoted = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep]
    return [f.name for f in keep], ", ".join([*quoted, *(f"`{k}` {v}" for k, v in fields.items())])


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new.values()], [*keep, *new])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    z = zstandard.ZstdCompressor(3)
    for batch in slices(batches, "text"):
        blobs = pa.array([z.compress(x) for x in raw(batch, "text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), blobs], ["part", "doc_id", "text"])


def unpacked(texts: pa.Table) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts in runs of about SLICE_BYTES."""
    z = zstandard.ZstdDecompressor()
    ids, found, size = [], [], 0
    for batch in texts.to_batches(1024):
        for i, blob in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            found.append(z.decompress(blob))
            size += len(found[-1])
            if size > SLICE_BYTES:
                yield ids, found
                ids, found, size = [], [], 0
    if ids:
        yield ids, found
