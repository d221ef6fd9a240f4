"""Duplicate providers: candidate pairs, similarity and field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.functions.bands import half_up, similarity_band
from rosterline.functions.validators import is_blank, normalize
from rosterline.operators.skew import copied
from rosterline.runtime import scratch

# Fields that make up the similarity, and those shown side by side.
SCORED = ("npi", "first_name", "last_name", "specialty", "state", "email", "phone", "address")
COMPARED = (*SCORED, "source")

# Rows that one task compares with their neighbours.
STRETCH = 65_536


def duplicate_pairs(
    records: DataFrame, block: str = "npi", key: str = "record_id", fields: tuple[str, ...] = COMPARED
) -> DataFrame:
    """Every duplicate paired with the first record of its block: ``rec1, rec2, a, b``.

    ``a`` and ``b`` are structs of ``fields``. A block of n records gives n - 1 pairs and reaches each
    of its records, so a placeholder number shared by very many records stays linear. Records with a
    blank block key have no duplicates.
    """
    named = records.where(~is_blank(F.col(block))).select(
        F.col(block).alias("_block"), F.col(key).alias("rec2"), F.struct(*fields).alias("b")
    )
    # one record per block goes on from each task; blocks of one record are left behind here
    first = (
        named.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("rec2").alias("rec1"), F.col("b").alias("a"))).alias("first"))
        .where("n > 1")
        .select(copied(F.col("_block")).alias("_first"), "first.*")
    )
    members = named.join(first, F.col("_block").cast("string") == F.col("_first"))
    return members.where("rec1 <> rec2").select(F.col("_block").alias("block"), "rec1", "rec2", "a", "b")


def neighbour_pairs(
    records: DataFrame,
    block: str = "npi",
    order: tuple[str, ...] = ("last_name", "first_name"),
    key: str = "record_id",
    fields: tuple[str, ...] = COMPARED,
    reach: int = 2,
    stretch: int = STRETCH,
) -> DataFrame:
    """Records of a block that are at most ``reach`` places apart in its order: ``block, rec1, rec2, a, b``, rec1 the earlier.

    This finds a pair that is alike though neither is like the first record of the block. n records give less than
    ``reach`` x n pairs. All blocks together are one sorted sequence, cut into stretches of equal length, each of which also
    gets the first rows of the next: a block of half the rows is spread over many tasks, and no pair is lost at a border.
    Blank blocks have no pairs; ties in the order go by the unique ``key``.
    """
    if not 0 < reach <= stretch:
        raise ValueError("reach must be positive and at most the stretch")
    spark = records.sparkSession
    named = records.where(~is_blank(F.col(block))).select(
        F.col(block).cast("string").alias("block"),
        F.array(*[normalize(F.col(c)) for c in order]).alias("place"),
        F.col(key).alias("rec"),
        F.struct(*fields).alias("fields"),
    )
    # Written, so that the numbers of the ranges hold for everything that follows, also when a task runs again.
    path = scratch(spark, "neighbours")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named.repartitionByRange(parts, "block", "place", "rec").withColumn("part", F.spark_partition_id()).write.parquet(path)
    sorted_rows = spark.read.parquet(path)
    # One row per range, so one task can add them up.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy("block", "place", "rec"))
    placed = sorted_rows.withColumn("at", inside).join(starts, "part").withColumn("at", F.col("at") + F.col("start") - 1)
    home = F.floor(F.col("at") / stretch)
    homes = F.when((F.col("at") % stretch < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = placed.select("block", "rec", "fields", "at", F.explode(homes).alias("home"))
    along = Window.partitionBy("home").orderBy("at")
    following = F.array(*[F.lead(F.struct("block", "rec", "fields"), i).over(along) for i in range(1, reach + 1)])
    own = dealt.withColumn("next", following).where(F.floor(F.col("at") / stretch) == F.col("home"))
    met = own.select(F.col("block").alias("of"), F.col("rec").alias("rec1"), F.col("fields").alias("a"), F.explode("next").alias("n"))
    return met.where(F.col("n.block") == F.col("of")).select(
        F.col("of").alias("block"), "rec1", F.col("n.rec").alias("rec2"), "a", F.col("n.fields").alias("b")
    )


def with_similarity(pairs: DataFrame, fields: tuple[str, ...] = SCORED) -> DataFrame:
    """Add the mean field similarity as 0-100 and its band.

    The similarity of a field is 1 - edit distance / longer length on lower-cased text.
    """
    lowered = {f"_{s}_{f}": F.lower(normalize(F.col(f"{s}.{f}"))) for f in fields for s in "ab"}

    def similar(field: str) -> Column:
        a, b = F.col(f"_a_{field}"), F.col(f"_b_{field}")
        longest = F.greatest(F.char_length(a), F.char_length(b))
        return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)

    total = sum((similar(f) for f in fields), F.lit(0.0))
    return (
        pairs.withColumns(lowered)
        .withColumn("similarity", half_up(total / len(fields) * 100))
        .withColumn("band", similarity_band(F.col("similarity")))
        .select(*pairs.columns, "similarity", "band")
    )


def with_differences(pairs: DataFrame, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """Add ``differences``: the fields whose values are not the same, with both values."""
    both = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("first"), F.col(f"b.{f}").alias("second"))
            for f in fields
        ]
    )
    return pairs.withColumn("differences", F.filter(both, lambda d: ~d["first"].eqNullSafe(d["second"])))


def with_origin(pairs: DataFrame) -> DataFrame:
    """Add whether the two records come from one upload or from two."""
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    return pairs.withColumn("origin", F.when(same, "Same upload").otherwise("Cross-upload"))


def by_name(pairs: DataFrame, descending: bool = False) -> DataFrame:
    """Pairs in order of the first record's "last first" name as a reader sorts names, ties by the second record."""
    name = F.collate(F.concat_ws(" ", "a.last_name", "a.first_name"), "UNICODE")
    return pairs.orderBy(name.desc() if descending else name.asc(), "rec2")
