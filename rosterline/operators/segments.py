"""Provider segments by specialty, geography and volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import FeatureHasher, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the hashed categories. No list of values is gathered, so a column may have any number of them.
HASHED = 1 << 12
#: Numbers are compared in thousandths of a standard deviation, so that every sum and distance is a whole number.
UNIT = 1000
#: Rows from which each first prototype is chosen.
TRIES = 8


def segment(
    df: DataFrame, categories: list[str], numbers: list[str], k: int = 6, seed: int = 42
) -> DataFrame:
    """Add ``segment``, the k-means cluster of the encoded categories and scaled numbers.

    Category values are hashed to one dimension each; a collision joins two values, which is rare while a column
    has far fewer values than dimensions.
    """
    encoded = Pipeline(
        stages=[
            FeatureHasher(inputCols=categories, outputCol="_categories", categoricalCols=categories, numFeatures=HASHED),
            VectorAssembler(inputCols=numbers, outputCol="_numbers", handleInvalid="keep"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
            VectorAssembler(inputCols=["_categories", "_scaled"], outputCol="_features"),
            KMeans(featuresCol="_features", predictionCol="segment", k=k, seed=seed),
        ]
    )
    # fitting reads the input several times; the lineage stays, so lost blocks are computed again
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = encoded.fit(kept)
    finally:
        kept.unpersist()
    return model.transform(df).select(*df.columns, "segment")


def prototypes(
    df: DataFrame, key: str, categories: list[str], numbers: list[str], k: int = 6, rounds: int = 10, mismatch: float = 0.5
) -> DataFrame:
    """Add ``segment`` (0 to k - 1), the nearest of k prototypes; a prototype is a mean of numbers and a mode of categories.

    The distance is the sum of squares over the numbers, in standard deviations, and ``mismatch`` for each category
    that differs. Category values are compared as they are, null being one of them; a number that is null or not
    finite counts as the mean. The first prototypes are the first different rows by md5 of the key, among
    ``TRIES * k``. A round is one scan with counts per segment and value; a prototype without rows stays as it is, and
    ties go to the smaller segment and the smaller value. It ends early when nothing moves. Only prototypes reach the
    driver: at most k rows. An empty table gives an empty result.
    """
    weight = round(mismatch * UNIT * UNIT)
    kinds, heights = [f"c{i}" for i in range(len(categories))], [f"z{i}" for i in range(len(numbers))]
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scales = _scales(kept, numbers)
        points = kept.select(
            F.coalesce(F.md5(F.col(f"`{key}`").cast("string")), F.lit("")).alias("first"), *_point(categories, numbers, kinds, heights, scales)
        )
        now = _first_prototypes(points, [*kinds, *heights], k)
        for _ in range(rounds if now else 0):
            before, now = now, _moved(points.withColumn("segment", _nearest(now, F.col, kinds, heights, weight)), now, kinds, heights)
            if now == before:
                break
    finally:
        kept.unpersist()
    of = dict(zip([*kinds, *heights], _point(categories, numbers, kinds, heights, scales), strict=True))
    found = _nearest(now, of.__getitem__, kinds, heights, weight) if now else F.lit(None).cast("long")
    return df.withColumn("segment", found)


def _finite(name: str) -> Column:
    """The number, null where it is not finite."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _scales(df: DataFrame, numbers: list[str]) -> list[tuple[float, float]]:
    """Mean and standard deviation of each number; a deviation of 0 where all are equal or none is there."""
    if not numbers:
        return []
    row = df.agg(*(f(_finite(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(numbers) for f in (F.avg, F.stddev_pop))).first()
    return [(row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i in range(len(numbers))]


def _point(categories: list[str], numbers: list[str], kinds: list[str], heights: list[str], scales: list[tuple[float, float]]) -> list[Column]:
    """Categories as text and numbers in units, under names of their own."""
    texts = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(categories, kinds, strict=True)]
    units = [
        F.coalesce(F.floor(UNIT * (_finite(c) - mean) / deviation + 0.5), F.lit(0)).cast("long") if deviation else F.lit(0).cast("long")
        for c, (mean, deviation) in zip(numbers, scales, strict=True)
    ]
    return [*texts, *(u.alias(n) for u, n in zip(units, heights, strict=True))]


def _first_prototypes(points: DataFrame, names: list[str], k: int) -> list[tuple]:
    """The first k different points of the ``TRIES * k`` first ones."""
    tries = points.orderBy("first", *names).limit(TRIES * k).collect()
    return list(dict.fromkeys(tuple(row[n] for n in names) for row in tries))[:k]


def _nearest(prototypes: list[tuple], column: Callable[[str], Column], kinds: list[str], heights: list[str], weight: int) -> Column:
    """Number of the nearest prototype, as an expression over the columns of a point."""

    def distance(prototype: tuple) -> Column:
        differs = [F.when(column(n).eqNullSafe(F.lit(v)), F.lit(0)).otherwise(F.lit(weight)) for n, v in zip(kinds, prototype)]
        gaps = [column(n) - F.lit(v).cast("long") for n, v in zip(heights, prototype[len(kinds) :])]
        return sum([*differs, *(g * g for g in gaps)], F.lit(0).cast("long"))

    found = [F.struct(distance(p).alias("distance"), F.lit(i).cast("long").alias("segment")) for i, p in enumerate(prototypes)]
    return F.array_min(F.array(*found))["segment"]


def _moved(points: DataFrame, before: list[tuple], kinds: list[str], heights: list[str]) -> list[tuple]:
    """The mode and the mean (rounded down) of each segment's rows."""
    # one row per category; the numbers go with the row of kind -1, which every point has once
    value = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("value"))
    values = F.array(value(-1, F.lit(None).cast("string")), *(value(i, F.col(c)) for i, c in enumerate(kinds)))
    counted = points.select("segment", *heights, F.inline(values)).groupBy("segment", "kind", "value")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(h) for h in heights))
    whole = lambda of: F.max(F.when(F.col("kind") == -1, of))
    modes = [F.min(F.when(F.col("kind") == i, F.struct((-F.col("n")).alias("order"), "value")))["value"].alias(c) for i, c in enumerate(kinds)]
    means = [F.floor(whole(F.col(h)) / whole(F.col("n"))).cast("long").alias(h) for h in heights]
    found = {row["segment"]: tuple(row[n] for n in [*kinds, *heights]) for row in counted.groupBy("segment").agg(*modes, *means, F.lit(1).alias("one")).collect()}
    return [found.get(i, old) for i, old in enumerate(before)]


def profile(df: DataFrame, segment: str, specialty: str, region: str) -> DataFrame:
    """Size, dominant specialty and dominant region per segment; first in order on ties.

    One pass counts per segment and value, so that no segment is gathered in one place.
    """
    values = F.array(
        F.struct(F.lit("specialty").alias("kind"), F.col(specialty).alias("value")),
        F.struct(F.lit("region").alias("kind"), F.col(region).alias("value")),
    )
    counted = df.select(segment, F.inline(values)).groupBy(segment, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.struct((-F.col("n")).alias("order"), "value")

    def dominant(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, ranked))["value"]

    return counted.groupBy(segment).agg(
        F.sum(F.when(F.col("kind") == "specialty", F.col("n"))).alias("size"),
        dominant("specialty").alias(specialty),
        dominant("region").alias(region),
    )
