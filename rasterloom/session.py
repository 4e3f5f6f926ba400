"""Session defaults and the shared folder for checkpoints, tables between steps and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A row can hold a whole image or a pixel column, so batches are cut by bytes as well.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Lets the image data source see filters; without it Spark applies them to the rows.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Files of a few kilobytes share a task by the thousand; a listing of many folders or files takes no task for each.
    "spark.sql.files.openCostInBytes": str(128 * 1024),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
}


def build_session(app: str = "rasterloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a session somebody else created."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_{spark.sparkContext.appName}-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, and lost executors cost nothing."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
