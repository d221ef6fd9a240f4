"""A count-min sketch that is spread over shards and asked in both directions.

A group of documents sends the counters it uses, sorted, as differences; with far more counters than values that is
about two bytes each. A shard holds a range of the counters and adds up the counts of all groups, so an estimate is
never too low. It answers with one bit per counter, in the order in which the group asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Counters per byte of text, at least (rounded up to a power of two).
COUNTERS_PER_BYTE = 4

ASKED = "shard long, part long, first long, steps binary, width int, counts binary, count_width int"
BITS = "part long, shard long, kind string, bits binary"


def bits_for(size: int) -> int:
    return max(20, (COUNTERS_PER_BYTE * size).bit_length())


def _width(values: np.ndarray) -> int:
    return next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))


def questions(part: int, counter: np.ndarray, counts: np.ndarray, bits: int, shards: int) -> pa.Table:
    """The counters of a group (sorted, distinct) and how often each is used, by shard."""
    edges, out = bounds(counter, bits, shards), []
    for s in np.flatnonzero(np.diff(edges)).tolist():
        own, n = counter[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
        steps = np.diff(own)
        w, v = _width(steps), _width(n)
        out.append((s, part, int(own[0]), steps.astype(f"<u{w}").tobytes(), w, n.astype(f"<u{v}").tobytes(), v))
    return rows(out, ASKED)


def estimate(least: int, many: int | None = None) -> Callable[[tuple, pa.Table], pa.Table]:
    """Answers "repeated" for counters of at least ``least``, and "many" for those above ``many`` if given."""

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        found, counts, where = [], [], []
        for row in asked.to_pylist():
            steps = np.frombuffer(row["steps"], f"<u{row['width']}")
            own = np.full(len(steps) + 1, row["first"], np.int64)
            own[1:] += np.cumsum(steps, dtype=np.int64)
            found.append(own)
            counts.append(np.frombuffer(row["counts"], f"<u{row['count_width']}"))
            where.append(row["part"])
        _, at = np.unique(np.concatenate(found), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts))[at]
        cut, out = np.cumsum([len(x) for x in found])[:-1], []
        for kind, flags in (("repeated", total >= least), ("many", total > many if many else None)):
            if flags is not None:
                out += [(part, key[0].as_py(), kind, np.packbits(x).tobytes()) for part, x in zip(where, np.split(flags, cut), strict=True)]
        return rows(out, BITS)

    return answer


def bounds(values: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where the values of each shard begin, for sorted values below 2^bits."""
    edges = [-(-(s << bits) // shards) for s in range(shards)]
    return np.append(np.searchsorted(values.astype(np.uint64), np.array(edges, np.uint64)), len(values))


def bit(table: pa.Table, kind: str) -> dict[int, np.ndarray]:
    """The answers of one kind by shard."""
    found = zip(*(table.column(k).to_pylist() for k in ("shard", "kind", "bits")), strict=True)
    return {shard: np.unpackbits(np.frombuffer(bits, np.uint8)) for shard, this, bits in found if this == kind}


def answers(bits: dict[int, np.ndarray], edges: np.ndarray) -> np.ndarray:
    """One flag per value asked about, given where the values of each shard begin."""
    out = np.zeros(edges[-1], bool)
    for s in np.flatnonzero(np.diff(edges)).tolist():
        out[edges[s] : edges[s + 1]] = bits[s][: edges[s + 1] - edges[s]]
    return out


def rows(values: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns: Iterator = zip(*values, strict=True) if values else ([] for _ in fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})
