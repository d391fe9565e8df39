"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from functools import cache
from pathlib import Path

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of whole texts handed to a Python worker at a time.
TEXT_ROWS, TEXT_BYTES = 512, "32m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few hundred rows or megabytes at a time, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)


@cache
def one_blas_thread() -> None:
    """Spark runs a task on each core, so a task's matrix products get one thread; more only wait for each other."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        setter = getattr(ctypes.CDLL(str(lib)), "scipy_openblas_set_num_threads64_", None)
        if setter:
            setter(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, without the setting, one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/vellum-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    return fold_of(doc_id) == 0


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and whole text (null: empty), and nothing else that docs may hold."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most bound labelled training rows (fold not 0) with their whole texts: doc_id, text, y.

    The rows with the smallest id hashes are taken, so the choice doesn't depend on partitioning.
    A document with several labels takes the largest; of rows that share an id, the one with the least
    text counts. The ids (bound rows of 16 bytes) are the broadcast side; texts are written once to
    the shared folder.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    return materialize(rows, f"sample-{target}")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
