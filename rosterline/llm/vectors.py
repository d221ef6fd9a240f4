"""Near-duplicate embeddings and nearest neighbours, in blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common, graph

#: Vectors of a tile, and rows of a tile that are multiplied at a time.
TILE, STRIP = 4096, 512
#: Vectors of a tree, points of a leaf, queries that go to a tree together.
TREE, LEAF, QUERIES = 8192, 32, 4096
#: Projected dimensions (even), and the confidence of the test that stops a search.
PROJECTED, CONFIDENCE = 8, 0.98
#: What rounding may add to a squared projected distance; leaves at the bound itself are read, as ties go to smaller ids.
MARGIN = 1e-9
_SEED = 7


def usable(vectors: DataFrame, identifier: str, embedding: str) -> DataFrame:
    """id, dim and the vector as float64 bytes, for vectors that have a direction; null ids are left out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, blobs = [], [], []
            for i, values in zip(batch.column("id").to_pylist(), batch.column("embedding"), strict=True):
                if not values.is_valid:
                    continue
                x = values.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    blobs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["id", "dim", "x"])

    named = vectors.select(F.col(identifier).cast("long").alias("id"), F.col(embedding).alias("embedding")).filter("id IS NOT NULL")
    return named.mapInArrow(check, "id long, dim int, x binary")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a length of 1 row by row, and their original lengths."""
    blobs = table.column("x").to_pylist()
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x, np.sqrt((x * x).sum(axis=1))


class _Quantised:
    """Int8 values, their scale, and the rigorous bound of what they miss of the unit vector."""

    def __init__(self, unit: np.ndarray):
        self.scale = np.abs(unit).max(axis=1) / 127
        self.values = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.values * self.scale[:, None]
        self.error = np.sqrt((rest * rest).sum(axis=1)) + 1e-9


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, identifier: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept: vectors linked by a cosine of at least ``threshold``.

    Equal vectors are one class before any are compared. The classes lie in tiles; each pair of tiles is one group
    of bounded size, which multiplies int8 values exactly, and recomputes in double precision the pairs whose
    product plus both error bounds reaches the threshold. A pair of tiles returns a sum per vector and at most one
    edge per vector (a spanning forest of its links), never the links themselves. Vectors of different dimensions
    don't link. A vector that is null, zero or not finite, or has a null id, has no links and is its own component.
    """
    found = common.stored(usable(vectors, identifier, embedding).withColumn("h", F.sha2("x", 256)), "vectors")
    classes = common.stored(found.groupBy("h", "dim").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x")), "vector-classes")
    tiles = max(1, -(-classes.count() // TILE))
    placed = classes.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    left = placed.select(F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"), "dim", "id", "n", "x")
    right = placed.select(F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), "dim", "id", "n", "x").filter("i <> j")
    groups = ["i", "j", "dim"]

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _compared(a, b if key[0].as_py() != key[1].as_py() else None, threshold)

    partial = common.stored(left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(compare, "id long, n long, link long"), "vector-links")
    counts = partial.groupBy("id").agg(F.sum("n").alias("links"))
    parents = graph.components(partial.filter("link <> id").select(F.col("id").alias("u"), F.col("link").alias("v")))
    of_class = (
        classes.select("h", F.col("id"), (F.col("n") - 1).alias("twins"))
        .join(counts, "id", "left")
        .join(parents.withColumnRenamed("node", "id"), "id", "left")
        .select("h", (F.col("twins") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = found.select("id", "h").join(of_class, "h").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = vectors.select(F.col(identifier).cast("long").alias("id"))
    return every.join(linked, "id", "left").select(
        F.col("id").alias(identifier),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id").isNotNull() & (F.col("id") == F.coalesce("component_id", "id"))).alias("kept"),
    )


def _compared(a: pa.Table, b: pa.Table | None, threshold: float) -> pa.Table:
    """Weighted link counts and a spanning forest of the links between two tiles, or within one (b None)."""
    empty = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "link": pa.array([], pa.int64())})
    if not a.num_rows or (b is not None and not b.num_rows):
        return empty
    same = b is None
    b = a if same else b
    (x, x_size), (y, y_size) = _matrix(a), _matrix(b)
    qx, qy = _Quantised(x / x_size[:, None]), _Quantised(y / y_size[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    turned = np.ascontiguousarray(qy.values.T.astype(exact))
    weight_a, weight_b = np.asarray(a.column("n")), np.asarray(b.column("n"))
    links_a, links_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    shift = 0 if same else len(x)
    parent = np.arange(len(x) + (0 if same else len(y)))
    for low in range(0, len(x), STRIP):
        rows = slice(low, min(low + STRIP, len(x)))
        product = (qx.values[rows].astype(exact) @ turned).astype(np.float64) * qx.scale[rows, None] * qy.scale
        product += qx.error[rows, None] + (1 + qx.error[rows, None]) * qy.error
        i, j = np.nonzero(product >= threshold)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 100_000):
            p, q = i[part : part + 100_000], j[part : part + 100_000]
            cosine = np.einsum("ij,ij->i", x[p], y[q]) / (x_size[p] * y_size[q])
            p, q = p[cosine >= threshold], q[cosine >= threshold]
            np.add.at(links_a, p, weight_b[q])
            np.add.at(links_a if same else links_b, q, weight_a[p])
            _union(parent, p, q + shift)
    ids = np.concatenate([np.asarray(a.column("id")), np.asarray(b.column("id"))]) if not same else np.asarray(a.column("id"))
    counts = links_a if same else np.concatenate([links_a, links_b])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, ids)
    on = counts > 0
    return pa.table({"id": ids[on], "n": counts[on], "link": least[parent][on]})


def _union(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the sets of p[k] and q[k]; every entry of parent is a root afterwards."""
    while True:
        a, b = parent[p], parent[q]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, identifier: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, id, score: for each query the ``k`` nearest rows by cosine, its own id left out.

    The rows lie in blocks; each block has a kd-tree over a stable (Gaussian) projection of its unit vectors. A
    search takes the leaves by distance from the projected query and verifies their points on the original
    vectors, until the chi-square test says that a point nearer than the k-th found would almost surely have been
    met: its squared projected over its squared true distance follows that distribution. The blocks' answers are
    merged. Rows and queries without a direction or with a null id take no part; a query finds rows of its own
    dimension; ties go to the smaller id.
    """
    rows = common.stored(usable(vectors, identifier, embedding), "index")
    asked = common.stored(usable(queries, identifier, embedding), "queries")
    blocks, parts = max(1, -(-rows.count() // TREE)), max(1, -(-asked.count() // QUERIES))
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    left = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", "id", "x")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), "dim", "id", "x")
    groups = ["block", "part", "dim"]

    def search(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _searched(a, b, k)

    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    merged = found.distinct().groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias(identifier), (-F.col("b.s")).alias("score")
    )


def chi_square_quantile(p: float, m: int) -> float:
    """Of the chi-square distribution with ``m`` degrees of freedom, m even."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if cdf < p else (low, x)
    return high


def _tree(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree: indices of points, split at the median of the widest dimension."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        width = np.ptp(points[at], axis=0)
        if len(at) <= LEAF or not width.any():
            leaves.append(at)
            continue
        order = at[np.argsort(points[at, int(width.argmax())], kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return leaves


def _searched(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if rows.num_rows and queries.num_rows:
        (x, x_size), (y, y_size) = _matrix(rows), _matrix(queries)
        ids, query_ids = np.asarray(rows.column("id")), np.asarray(queries.column("id"))
        unit = x / x_size[:, None]
        lines = np.random.default_rng(_SEED).standard_normal((x.shape[1], PROJECTED))
        points, centres = unit @ lines, (y / y_size[:, None]) @ lines
        leaves = _tree(points)
        lows, highs = (np.stack([f(points[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        enough = chi_square_quantile(CONFIDENCE, PROJECTED)
        for q, query_id in enumerate(query_ids):
            gap = np.maximum(np.maximum(lows - centres[q], centres[q] - highs), 0)
            distance = (gap * gap).sum(axis=1)
            order = np.argsort(distance, kind="stable")
            at, step, best, score = 0, 4, np.zeros(0, np.int64), np.zeros(0)
            while at < len(order):
                new = np.concatenate([leaves[j] for j in order[at : at + step]])
                new = new[ids[new] != query_id]
                cosine = (x[new] * y[q]).sum(axis=1) / (x_size[new] * y_size[q])
                best, score = np.concatenate([best, new]), np.concatenate([score, cosine])
                top = np.lexsort((ids[best], -score))[:k]
                best, score, at, step = best[top], score[top], at + step, step * 2
                if len(best) == k and at < len(order) and distance[order[at]] > enough * max(2 - 2 * score[-1], 0) + MARGIN:
                    break
            out[0].extend([query_id] * len(best))
            out[1].extend(ids[best])
            out[2].extend(score)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})
