"""Incremental ingest of CSV uploads with a running row count."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterline.sources import upload


def csv_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The ``file`` paths of new CSV files below ``path``, its folders included; their content is not read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.lit(path).alias("root"))
    )


def start(stream: DataFrame, columns: list[str], out: str, checkpoint: str, key: str = "upload_id") -> StreamingQuery:
    """Read the files of the stream as :func:`upload.read` does, so that batch and stream agree, and append to
    ``out``: ``records``, ``quarantine``, ``rejected`` files with their verdict, and ``counts`` per ``key``.

    ``upload_id`` is the path of a file below the folder of the stream, so equal names of two tenants stay apart.
    Records have all ``columns``, NULL where a file lacks one, and whatever else a file has; read them with
    ``mergeSchema``. One checkpointed query writes all. Each micro-batch owns its ``batch_id`` folders and
    overwrites them when it is run again, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def folder(name: str) -> str:
            return f"{out}/{name}/batch_id={batch_id}"

        files = batch.distinct().collect()  # at most files_per_batch
        if not files:
            return
        spark = batch.sparkSession
        found = upload.scan(spark, [upload.literal_path(f["file"]) for f in files])
        found = replace(found, records=found.records.persist())  # parsed once for all that is written

        def named(frame: DataFrame) -> DataFrame:
            return frame.withColumn("upload_id", upload.below(F.col("file"), F.lit(files[0]["root"]))).drop("file")

        known = upload.column_names(found)
        have = {c.lower() for c in known}
        missing = [F.lit(None).cast("string").alias(c) for c in columns if c.lower() not in have]
        records = named(upload.by_name(found, known).select("*", *missing))
        records.write.mode("overwrite").parquet(folder("records"))
        named(found.quarantine.select("raw", F.size("values").alias("fields"), "file")).write.mode("overwrite").parquet(folder("quarantine"))
        rejected = found.files.where("status <> 'ok'").select("file", "status", "line_number")
        named(rejected).write.mode("overwrite").parquet(folder("rejected"))
        records.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder("counts"))
        found.records.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_totals(spark: SparkSession, out: str, key: str = "upload_id") -> DataFrame:
    """Rows ingested so far per ``key``; reads the small counts, not the records."""
    return spark.read.parquet(f"{out}/counts").groupBy(key).agg(F.sum("rows").alias("total_rows"))
