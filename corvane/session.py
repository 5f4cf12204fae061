"""Session defaults and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cores: int | str = "*", app: str = "corvane", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE on and Arrow batches of a few thousand rows.

    On a cluster the caller brings its own session; no operator needs this one.
    """
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .config("spark.sql.python.filterPushdown.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables, read lazily with its stored schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/engine-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """df, written to the shared folder and read back, in folders by a column if told: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.options(**options or {})
    out = out.partitionBy(by) if by else out
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
