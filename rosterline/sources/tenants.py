"""Tenant tables: scans, guarded upserts and stacking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store rows below one folder per tenant, so that a tenant scan reads only its own files.

    Rebalancing gathers small tenants in few files and splits large ones over many tasks.
    """
    df.hint("rebalance", "company_id").write.mode(mode).partitionBy("company_id").parquet(path)


def tenant(df: DataFrame, company_id: str) -> DataFrame:
    """All rows of one tenant; on a table from :func:`write_records` this prunes partitions."""
    return df.where(F.col("company_id") == company_id)


def of_companies(children: DataFrame, companies: DataFrame) -> DataFrame:
    """Children of existing companies only."""
    return children.join(companies, "company_id", "left_semi")


def guard(payload: DataFrame, target: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that name the target tenant and the rejected ones with a reason."""
    given = F.coalesce(F.col("company_id"), F.lit(""))
    reason = F.when(given == "", "company_id is required for tenant-scoped documents").when(
        given != target, "Payload company_id must match the path company_id"
    )
    judged = payload.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last write wins per key. The newest version is a maximum, so both inputs pre-aggregate."""
    stacked = current.unionByName(changes, allowMissingColumns=True)
    payload = [c for c in stacked.columns if c not in (*keys, *version)]
    newest = stacked.groupBy(*keys).agg(F.max(F.struct(*version, *payload)).alias("newest"))
    return newest.select(*keys, *[F.col(f"newest.{c}").alias(c) for c in (*version, *payload)])


def stack(*frames: DataFrame) -> DataFrame:
    """Rows with differing columns in one frame; a column a row lacks is NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create(rows: DataFrame, path: str) -> None:
    """A stored tenant table that :func:`merge` can change: ``data`` by batch and tenant, ``manifest`` says which batch counts."""
    if rows.isEmpty():
        raise ValueError("a stored tenant table starts with at least one row")
    _publish(rows, path, "start", 0)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The current rows: those of each tenant's newest batch. Folders that no longer count are pruned by the manifest."""
    newest = _manifest(spark, path).where("seq >= 0").groupBy("company_id").agg(F.max_by("batch", "seq").alias("batch"))
    return _as_text(spark, f"{path}/data", "company_id", "batch").join(newest, ["company_id", "batch"], "left_semi").drop("batch")


def merge(changes: DataFrame, path: str, keys: list[str], version: list[str], batch: str) -> bool:
    """Apply a batch of changes, last write wins; False if this batch was applied before, then nothing is written.

    Only tenants that occur in the batch are read and written anew, below a folder of the batch; files of others stay as
    they are. Readers see the batch once its single manifest file is there, so a job that dies halfway has no effect and
    may run again. One writer at a time. A change without a tenant is an error, see :func:`guard`.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch id is made of letters, digits, _, . and -")
    spark = changes.sparkSession
    applied = _manifest(spark, path)
    if not applied.where(F.col("batch") == batch).isEmpty():
        return False
    touched = changes.select(F.col("company_id").cast("string").alias("company_id")).distinct()
    current = stored(spark, path).join(touched, "company_id", "left_semi")
    _publish(upsert(current, changes, ["company_id", *keys], version), path, batch, applied.agg(F.max("seq")).first()[0] + 1)
    return True


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("company_id string, batch string, seq long").parquet(f"{path}/manifest")


def _as_text(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """A partitioned table whose folder names are taken as text, also where they look like numbers."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in names else f for f in found.fields])
    return spark.read.schema(schema).parquet(path)


def _publish(rows: DataFrame, path: str, batch: str, seq: int) -> None:
    spark, folder = rows.sparkSession, f"{path}/data/batch={batch}"
    named = F.col("company_id").cast("string")
    sure = F.when(F.length(named) > 0, named).otherwise(F.raise_error(F.lit("a row without company_id")))
    write_records(rows.withColumn("company_id", sure), folder, "overwrite")
    manifest = rows.limit(0).select(named.alias("company_id"))
    if not spark.read.schema(rows.schema).parquet(folder).isEmpty():
        manifest = _as_text(spark, folder, "company_id").select("company_id").distinct()
    manifest = manifest.select("company_id", F.lit(batch).alias("batch"), F.lit(seq).cast("long").alias("seq"))
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
