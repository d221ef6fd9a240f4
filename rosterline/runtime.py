"""Session settings, table access and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(master: str = "local[*]", app: str = "rosterline", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, ANSI and AQE."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables and checkpoints.

    On a cluster this lies in the shared folder named by ``spark.checkpoint.dir``, so that any
    executor or a restarted driver can reach it. Only where that setting is absent (tests on one
    machine) a temporary folder is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
    return tempfile.mkdtemp(prefix=f"{label}-")
