"""Statistical and plausibility outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.functions.bands import anomaly_band
from rosterline.operators.skew import copied

# Ratio to the group average, and distance in deviations, that are reported.
RATIO = 10.0
DEVIATIONS = 3.0
MAX_STATES = 10
MAX_YEARS_AHEAD = 20


def group_statistics(rows: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Size, mean, deviation and exact 99th percentile per group; all of them pre-aggregate."""
    v = F.col(value).cast("double")
    stats = rows.groupBy(group).agg(
        F.count(v).alias("group_size"), F.avg(v).alias("group_mean"), F.stddev_samp(v).alias("group_sd"), _band(v, 0.99, accuracy).alias("_band")
    )
    found = _in_band(rows, stats, group, v, 0.99).select(copied(F.col(group)).alias("_of"), F.col("percentile").alias("group_p99"))
    return stats.drop("_band").join(found, F.col(group).cast("string") == F.col("_of"), "left").drop("_of")


def group_percentile(rows: DataFrame, group: str, value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """``group, percentile``: the smallest value with at least the share ``q`` of its group's values up to it.

    Exact for any partitioning, in two passes: a sketch per group gives a band of values that the percentile lies in;
    the rows below it are counted, and only those within, some 4/``accuracy`` of a group and its equal values once, are
    put in order. Nulls don't count; a group without values has no row.
    """
    v = F.col(value).cast("double")
    bands = rows.groupBy(group).agg(F.count(v).alias("group_size"), _band(v, q, accuracy).alias("_band"))
    return _in_band(rows, bands, group, v, q)


def _band(v: Column, q: float, accuracy: int) -> Column:
    """Two values around the percentile, further off than the sketch's rank error of 1/``accuracy``."""
    reach = 2 / accuracy
    return F.percentile_approx(v, [max(0.0, q - reach), min(1.0, q + reach)], accuracy)


def _in_band(rows: DataFrame, bands: DataFrame, group: str, v: Column, q: float) -> DataFrame:
    low, high = F.col("_band")[0], F.col("_band")[1]
    named = bands.select(copied(F.col(group)).alias("_of"), "group_size", "_band")
    near = rows.select(group, v.alias("_v")).join(named, F.col(group).cast("string") == F.col("_of")).where(F.col("_v") <= high)
    # All values below the band are one row per task, those within one row per value.
    counted = near.groupBy(group, F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.first("group_size").alias("_size"))
    upto = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy(F.asc_nulls_first("_v"))))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_size") * F.lit(q).cast("decimal(18,12)")))
    first = F.min_by(F.struct("_v"), F.col("_upto")).alias("_first")
    # The first row that reaches the rank lies in the band, unless the sketch broke its promise.
    reached = upto.where(F.col("_upto") >= rank).groupBy(group).agg(first)
    sure = F.when(F.col("_first._v").isNotNull(), F.col("_first._v")).otherwise(F.raise_error(F.lit("percentile outside its band")))
    return reached.select(group, sure.alias("percentile"))


def distant() -> Column:
    """Whether a row with scores is far from its group: ratio to the mean, z-score or above the 99th percentile."""
    return (F.abs("z") > DEVIATIONS) | (F.col("ratio") >= RATIO) | F.col("above_p99")


def with_scores(rows: DataFrame, group: str, value: str, how: str = "inner", of: DataFrame | None = None) -> DataFrame:
    """Rows with their distance from their group; those without a group are kept by a left join.

    ``of`` has the rows that the statistics are taken from, where ``rows`` took joins to make.
    """
    stats = group_statistics(rows if of is None else of, group, value)
    stats = stats.withColumn("_group", copied(F.col(group))).drop(group)
    v = F.col(value).cast("double")
    z = F.try_divide(v - F.col("group_mean"), F.col("group_sd"))
    return (
        rows.join(stats, F.col(group).cast("string") == F.col("_group"), how)
        .drop("_group")
        .withColumn("z", z)
        .withColumn("ratio", F.try_divide(v, F.col("group_mean")))
        .withColumn("above_p99", v > F.col("group_p99"))
        .withColumn("anomaly_score", 1 - 1 / (1 + F.abs(F.coalesce("z", F.lit(0.0)))))
        .withColumn("severity", anomaly_band(F.col("anomaly_score")))
    )


def statistical_outliers(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows far from their group."""
    return with_scores(rows, group, value).where(distant())


def geographic_spread(activity: DataFrame, keys: list[str], state: str, limit: int = MAX_STATES) -> DataFrame:
    """Providers active in more states than plausible. Distinct states are found before the count."""
    return (
        activity.select(*keys, state)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(state).alias("states"))
        .where(F.col("states") > limit)
    )


def spread(activity: DataFrame, keys: list[str], state: str, limit: int = MAX_STATES) -> DataFrame:
    """``keys, states`` of those active in more than ``limit`` states, in one aggregate.

    States are two-letter codes in any case; other values count as none. A set of them is a bitmap in eleven numbers that
    combine by OR, so each task sends on one short row per key and no value is shuffled to tell it apart from others.
    """
    coded = activity.select(*keys, F.upper(F.trim(F.col(state).cast("string"))).alias("_code"))
    code = F.col("_code")
    index = (F.ascii(code) - 65) * 26 + F.ascii(F.substr(code, F.lit(2))) - 65
    # Two plain capitals are told by their codes; the pattern is tried on the rest.
    capitals = [F.ascii(c).between(65, 90) for c in (code, F.substr(code, F.lit(2)))]
    plain = (F.char_length(code) == 2) & capitals[0] & capitals[1]
    given = coded.select(*keys, F.when(plain | code.rlike("^[A-Z]{2}$"), index).alias("_i"))
    words = range(-(-26 * 26 // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i") % 64)
    placed = given.select(*keys, F.call_function("shiftright", F.col("_i"), F.lit(6)).alias("_at"), bit.alias("_bit"))
    sets = placed.groupBy(*keys).agg(*[F.bit_or(F.when(F.col("_at") == w, F.col("_bit"))).alias(f"_w{w}") for w in words])
    states = sum((F.coalesce(F.bit_count(f"_w{w}"), F.lit(0)) for w in words), F.lit(0)).cast("long")
    return sets.select(*keys, states.alias("states")).where(F.col("states") > limit)


def implausible_expiry(rows: DataFrame, expiry: str, as_of: str, years: int = MAX_YEARS_AHEAD) -> DataFrame:
    """Rows whose expiry lies more than ``years`` after ``as_of``."""
    latest_plausible = F.add_months(F.lit(as_of).cast("date"), 12 * years)
    return rows.where(F.col(expiry).cast("date") > latest_plausible)


def domain_mismatch(
    rows: DataFrame, practices: DataFrame, key: str, email: str = "email"
) -> DataFrame:
    """Rows whose e-mail domain is not the one expected for their practice.

    ``practices`` has one ``(key, email_domain)`` row per practice; without an expected domain or without an e-mail there is
    nothing to report.
    """
    expected = practices.select(key, F.lower("email_domain").alias("expected_domain")).where(
        "expected_domain IS NOT NULL"
    )
    actual = F.split_part(F.lower(F.col(email)), F.lit("@"), F.lit(2))
    given = rows.where(F.col(email).contains("@")).withColumn("actual_domain", actual)
    return given.join(expected, key).where("actual_domain <> expected_domain")
