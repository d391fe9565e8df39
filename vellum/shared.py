"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the setting names; on one machine, without the setting, one in the warehouse."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/vellum-shared"
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can reread it."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few hundred rows or megabytes at a time, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
