"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class. Each tree of the forest is a sorted order of the classes by some of
their hashes. Where few classes share a prefix, all of them are neighbours; where many do, the region is searched at
the next depth. Neighbours whose sketches and set sizes allow the threshold are candidates. Candidates are confirmed
on full sets, a spanning forest of the likeliest first; pairs that are already connected need no look.

A region with many classes at the least depth is crowded. Where its classes are still in several components, all pairs
across components are compared on full sets in tiles, so that no pair that shares such a prefix goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm import common, graph

#: Trees, hashes in the order of each, and the least common prefix of neighbours.
TREES, DEPTH, LEAST_DEPTH = 16, 6, 3
#: Classes of a region whose pairs are all candidates.
REGION = 6
#: Classes that are compared at a time; a region cut there is whole in the other orders.
CHUNK = 100_000
#: A candidate's similarity as estimated from two bits of each hash (standard deviation 0.049 at 0.8) may be lower
#: than the threshold by this much: a loss below 1e-8 of the pairs, where the trees themselves lose 1e-5.
SLACK = 0.3
#: Pairs of two components that are confirmed in the second round; the third takes all that are left.
SECOND_ROUND = 8
#: Shingles of a tile of classes that are compared at a time (a class counts for LEAST_SHINGLES at least, so that a tile has
#: at most 1,024 of them), and columns of the matrices that are multiplied.
TILE, LEAST_SHINGLES, COLUMNS = 1 << 18, 256, 4096

_ROW = ("doc_id", "row_a", "row_b")
_HASHES = TREES * DEPTH
_SEEDS = np.random.default_rng(51).integers(1, 1 << 63, (2, _HASHES), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of lower-cased words, and the text number of each, sorted by text and hash.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    data, begins = common.joined(texts)
    data = common.lower_ascii(data)
    starts, ends, of = common.words(data, begins)
    value = common.Hashes(data, 52).of(starts, ends)
    at = np.flatnonzero(of[shingle - 1 :] == of[: max(0, len(of) - shingle + 1)])
    h, doc = common.runs_of(value, shingle, 53)[at], of[at]
    count = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    for k in np.flatnonzero((count > 0) & (count < shingle)).tolist():
        n = int(count[k])
        h = np.append(h, common.mix(common.runs_of(value[first[k] : first[k] + n], n, 53) ^ np.uint64(n)))
        doc = np.append(doc, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _classes(h: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set, and two sums over it, mixed: equal for equal sets in any order."""
    size = np.bincount(doc, minlength=texts)
    sums = np.zeros((texts, 2), np.uint64)
    if len(h):
        at = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size)])[at]
        sums[at, 0] = np.add.reduceat(h, starts)
        sums[at, 1] = np.add.reduceat(common.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return size, common.mix(sums[:, 0] ^ common.mix(sums[:, 1] + size.astype(np.uint64))).view(np.int64)


def signatures(docs: DataFrame, text: str, identifier: str, shingle: int) -> DataFrame:
    """doc_id, row_a, row_b, n_shingles, class (of equal sets; null without words) and signature of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            h, doc = shingle_sets(common.raw(batch, "text"), shingle)
            size, group = _classes(h, doc, batch.num_rows)
            at = np.flatnonzero(size)
            hashes = np.zeros((batch.num_rows, _HASHES), ">u4")
            if len(at):
                starts = np.concatenate([[0], np.cumsum(size)])[at]
                for j in range(_HASHES):
                    hashes[at, j] = np.minimum.reduceat((h * _SEEDS[0, j] + _SEEDS[1, j]) >> np.uint64(32), starts)
            none = size == 0
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in _ROW), pa.array(size), pa.array(group, mask=none),
                pa.array([None if x else s.tobytes() for x, s in zip(none, hashes, strict=True)], pa.binary()),
            ], [*_ROW, "n_shingles", "class", "signature"])

    named = docs.select(F.col(identifier).cast("long").alias("doc_id"), *common.row_keys(docs), F.col(text).alias("text"))
    return named.mapInArrow(sign, "doc_id long, row_a long, row_b long, n_shingles long, class long, signature binary")


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """u, v (u < v), likeness, region of neighbouring classes whose similarity may reach ``least``; a pair may come twice.

    A row with u = v says that the class lies in a crowded region: not all of its classes were compared with each other.
    """

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u4").reshape(-1, _HASHES)
            low = s.astype(np.uint8) & 3
            bits = (low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6).astype(np.uint8)
            sketch = pa.array([x.tobytes() for x in bits], pa.binary())
            for t in range(TREES):
                keys = pa.array([bytes([t]) + x.tobytes() for x in s[:, t * DEPTH : (t + 1) * DEPTH]], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, batch.column("class"), batch.column("n_shingles"), sketch], ["key", "class", "n", "sketch"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield _neighbours(pa.Table.from_batches(held), least)
                held = []
        if held:
            yield _neighbours(pa.Table.from_batches(held), least)

    forest = classes.mapInArrow(orders, "key binary, class long, n long, sketch binary")
    ordered = forest.repartitionByRange("key", "class").sortWithinPartitions("key", "class")
    return ordered.mapInArrow(neighbours, "u long, v long, likeness double, region long")


def _neighbours(rows: pa.Table, least: float) -> pa.RecordBatch:
    n = rows.num_rows
    raw = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    keys = np.concatenate([raw[:, :1].astype(np.uint32), np.ascontiguousarray(raw[:, 1:]).view(">u4").astype(np.uint32)], axis=1)
    common_prefix = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1) - 1
    settled = np.zeros(n, bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    region = np.zeros(n, np.int64)
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        region = np.concatenate([[0], np.cumsum(common_prefix < depth)])[:n]
        small = (np.bincount(region)[region] <= REGION) & ~settled if n else settled
        for step in range(1, REGION):
            i = np.flatnonzero(small[:-step] & (region[:-step] == region[step:]))
            pairs.append((i, i + step))
        settled |= small
        if depth == LEAST_DEPTH:  # a region at either end may go on in another chunk
            crowded = ~settled | (region == 0) | (region == region[-1:])
    # What is left agrees on the whole order: each with the first of its region. Besides, the next two in any region.
    i = np.flatnonzero(~settled)
    leader = np.searchsorted(region, region[i])
    pairs.append((leader[leader < i], i[leader < i]))
    for step in (1, 2):
        reach = common_prefix if step == 1 else np.minimum(common_prefix[:-1], common_prefix[1:])
        i = np.flatnonzero(reach >= LEAST_DEPTH)
        pairs.append((i, i + step))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    once = np.unique(i * max(n, 1) + j)
    i, j = once // max(n, 1), once % max(n, 1)
    size = rows.column("n").to_numpy()
    i, j = (x[np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) * (1 - 1e-9)] for x in (i, j))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    other = sketch[i] ^ sketch[j]
    agree = 1 - np.bitwise_count((other | other >> 1) & 0x55).sum(axis=1) / _HASHES
    likeness = (agree - 0.25) / 0.75
    on = likeness >= least - SLACK
    group = rows.column("class").to_numpy()
    at = np.flatnonzero(crowded)
    u, v, likeness = (np.concatenate(x) for x in ((group[i[on]], group[at]), (group[j[on]], group[at]), (likeness[on], np.ones(len(at)))))
    # The tree and its least prefix, hashed: two regions that meet are compared as one, which loses nothing.
    prefix = np.zeros(len(at), np.uint64)
    for column in keys[at, : LEAST_DEPTH + 1].T:
        prefix = common.mix(prefix * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    named = pa.concat_arrays([pa.nulls(len(u) - len(at), pa.int64()), pa.array(prefix.view(np.int64))])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(likeness), named], ["u", "v", "likeness", "region"])


def across(members: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """u, v (u < v): all similar pairs of one region's classes that lie in different components.

    ``members`` are region, class, component, n_shingles. A region whose classes are all connected needs no look; of the
    others, classes of the component with the most shingles there are compared with the rest, not with each other. Both
    parts are cut into tiles, and a task multiplies the sets of two tiles. Only links leave a task.
    """
    weight = F.greatest(F.col("n_shingles"), F.lit(LEAST_SHINGLES))
    parts = members.groupBy("region", "component").agg(F.sum(weight).alias("weight"))
    tiles = lambda c: F.ceil(c / TILE)
    regions = parts.groupBy("region").agg(F.count("*").alias("parts"), F.max(F.struct("weight", "component")).alias("main"), F.sum("weight").alias("weight"))
    regions = regions.where("parts > 1").select(
        F.col("region").bitwiseXOR(F.lit(0)).alias("_region"), F.col("main.component").alias("main"),
        tiles(F.col("main.weight")).alias("n_main"), tiles(F.col("weight") - F.col("main.weight")).alias("n_rest"),
    )
    open_ = common.stored(members.join(regions, F.col("region") == F.col("_region")).drop("_region"), "open-regions")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = _split(*shingle_sets(common.raw(batch, "text"), shingle), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([x.tobytes() for x in found], pa.binary())], ["class", "shingles"])

    wanted = open_.select("class").distinct()
    known = texts.join(wanted, "class").select("class", "text").mapInArrow(sets, "class long, shingles binary")
    # Main tiles are 0, 1, ..., the others follow; a cell is a pair of tiles, not both main.
    is_main, hashed = F.col("component") == F.col("main"), F.xxhash64("class", F.lit(7))
    tile = F.when(is_main, F.pmod(hashed, F.col("n_main"))).otherwise(F.col("n_main") + F.pmod(hashed, F.col("n_rest")))
    first = F.when(is_main, F.col("n_main")).otherwise(F.lit(0).cast("long"))
    placed = open_.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(first, F.col("n_main") + F.col("n_rest") - 1)))
    cells = placed.select("region", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "class", "component")

    def compare(rows: pa.Table) -> pa.Table:
        return _links(rows, share)

    return cells.join(known, "class").groupBy("region", "low", "high").applyInArrow(compare, "u long, v long").distinct()


def _links(rows: pa.Table, share: tuple[int, int]) -> pa.Table:
    """The similar pairs of one cell, across components, by products of the matrices of shingles that several sets hold."""
    group, component, tile = (rows.column(c).to_numpy() for c in ("class", "component", "tile"))
    blobs = rows.column("shingles").to_pylist()
    size = np.array([len(b) // 8 for b in blobs], np.int64)
    _, code, count = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True, return_counts=True)
    several = count > 1
    column = (np.cumsum(several) - 1)[code]
    at = np.flatnonzero(several[code])
    doc, column = np.repeat(np.arange(len(size)), size)[at], column[at]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    left = np.flatnonzero(tile == rows.column("low")[0].as_py())
    right = np.flatnonzero(tile == rows.column("high")[0].as_py())
    both = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(several.sum()), COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        dense = np.zeros((len(size), COLUMNS), np.float32)
        dense[doc[low:high], column[low:high] - begin] = 1
        both += dense[left] @ dense[right].T
    inter = both.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - inter
    i, j = np.nonzero((share[1] * inter >= share[0] * union) & (component[left][:, None] != component[right][None, :]) & (union > 0))
    u, v = group[left[i]], group[right[j]]
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) with share[1] * intersection >= share[0] * union, on full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text_u"):
            left, right = (_split(*shingle_sets(common.raw(batch, c), shingle), batch.num_rows) for c in ("text_u", "text_v"))
            both = np.array([len(np.intersect1d(a, b, True)) for a, b in zip(left, right, strict=True)], np.int64)
            union = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64) - both
            yield batch.select(["u", "v"]).filter(pa.array(share[1] * both >= share[0] * union))

    named = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("u", "v").join(named("u"), "u").join(named("v"), "v").mapInArrow(compare, "u long, v long")


def _split(h: np.ndarray, doc: np.ndarray, texts: int) -> list[np.ndarray]:
    return np.split(h, np.cumsum(np.bincount(doc, minlength=texts))[:-1])


def near_duplicates(
    docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), text: str = "text", identifier: str = "doc_id"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked are texts with a similarity of at least share.

    Null texts and texts without words have no shingles, aren't linked and are their own component. A component's
    id is its smallest doc_id; null ids aren't chosen, and a row with a null id isn't kept. Rows with equal ids and
    texts are linked and both kept. An empty table gives an empty result.
    """
    found = _found(docs.select(identifier, text), shingle, share, text, identifier)
    chosen: Column = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", chosen.alias("component_id"), F.coalesce(F.col("doc_id") == chosen, F.lit(False)).alias("kept"))


def one_of_each(
    docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), text: str = "text", identifier: str = "doc_id"
) -> DataFrame:
    """The rows of docs, one for each component of near-duplicates, whatever its ids; all rows without words.

    It is the one with the smallest id, a null id last, and among equal ids the one with the smallest hash over all
    columns, so that a retry chooses the same. Rows with equal ids whose texts aren't similar all stay.
    """
    found = _found(docs, shingle, share, text, identifier)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *_ROW)).alias("first")
    chosen = found.filter("class IS NOT NULL").groupBy("component").agg(first).select("first.row_a", "first.row_b", F.lit(False).alias("every"))
    kept = chosen.unionByName(found.filter("class IS NULL").select("row_a", "row_b").distinct().withColumn("every", F.lit(True)))
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), *common.row_keys(docs)).join(kept, ["row_a", "row_b"])
    once = rows.groupBy("row_a", "row_b", "every").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.when(F.col("every"), F.col("n")).otherwise(1)))).select("row.*")


def _found(docs: DataFrame, shingle: int, share: tuple[int, int], text: str, identifier: str) -> DataFrame:
    """doc_id, row_a, row_b, n_shingles, class, component and component_id (its smallest doc_id) of every row."""
    signed = common.stored(signatures(docs, text, identifier, shingle), "signatures")
    classes = common.stored(
        signed.filter("class IS NOT NULL").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct("row_a", "row_b")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    neighbours = common.stored(candidates(classes, share[0] / share[1]).groupBy("u", "v", "region").agg(F.max("likeness").alias("likeness")), "candidates")
    labels = _components(neighbours, classes, _texts(neighbours, classes, docs, text), shingle, share)
    component = F.coalesce("component", "class")
    of_class = classes.select("class", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", component)
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_class.select("class", "component").join(least, "component").select("class", "component", "component_id")
    return signed.drop("signature").join(named, "class", "left")


def _texts(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """class, text for the classes in pairs, of the row that stands for the class."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct().join(classes.select("class", "row.row_a", "row.row_b"), "class")
    named = docs.select(*common.row_keys(docs), F.col(text).alias("text"))
    return common.stored(wanted.join(named, ["row_a", "row_b"]).select("class", "text").dropDuplicates(["class"]), "candidate-texts")


def _components(neighbours: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """node, component of the confirmed links: the likeliest earlier neighbour of each class, then what is still apart.

    At last come the pairs of crowded regions that the forest didn't compare.
    """
    pairs, crowded = neighbours.filter("region IS NULL").drop("region"), neighbours.filter("region IS NOT NULL").select(F.col("u").alias("class"), "region")
    early, late = F.xxhash64("u") < F.xxhash64("v"), F.xxhash64("u") >= F.xxhash64("v")
    turned = pairs.select(F.when(early, F.col("v")).otherwise(F.col("u")).alias("child"), F.when(late, F.col("v")).otherwise(F.col("u")).alias("parent"), "likeness")
    best = turned.groupBy("child").agg(F.max(F.struct("likeness", "parent")).alias("best")).select("child", F.col("best.parent").alias("parent"))
    tested = common.stored(best.select(F.least("child", "parent").alias("u"), F.greatest("child", "parent").alias("v")), "tested")
    links = common.stored(confirmed(tested, texts, shingle, share), "links")
    state = _rounds(pairs, texts, shingle, share, (tested, links, graph.components(links)))
    if not crowded.isEmpty():
        members = crowded.join(classes.select("class", "n_shingles"), "class").join(state[2].withColumnRenamed("node", "class"), "class", "left")
        more = common.stored(across(members.withColumn("component", F.coalesce("component", "class")), texts, shingle, share), "links")
        if not more.isEmpty():
            return graph.components(state[1].unionByName(more))
    return state[2]


def _rounds(
    pairs: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int], state: tuple[DataFrame, DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tested pairs, links and labels once all ``pairs`` that are apart are tested, the likeliest of two components first."""
    tested, links, labels = state
    for most in (SECOND_ROUND, None):
        u, v = (labels.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}")) for c in "uv")
        left = pairs.join(u, "u", "left").join(v, "v", "left").withColumns({f"at_{c}": F.coalesce(f"at_{c}", c) for c in "uv"}).filter("at_u <> at_v")
        left = left.join(tested, ["u", "v"], "left_anti")
        if most:
            ranked = Window.partitionBy(F.least("at_u", "at_v"), F.greatest("at_u", "at_v")).orderBy(F.desc("likeness"), "u", "v")
            left = left.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most)
        left = common.stored(left.select("u", "v"), "tested")
        if left.isEmpty():
            break
        more = common.stored(confirmed(left, texts, shingle, share), "links")
        tested, links = tested.unionByName(left), links.unionByName(more)
        if not more.isEmpty():
            labels = graph.components(links)
    return tested, links, labels
