"""Incremental maintenance of an index by content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(disk: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """path, action (index, skip, prune) from notes on disk and in the index (path, doc_hash)."""
    s = stored.groupBy("path").agg(F.max("doc_hash").alias("stored_hash"))
    both = disk.select("path", "doc_hash").join(s, "path", "full")
    same = F.lit(not force) & (F.col("doc_hash") == F.col("stored_hash"))
    return both.select("path", F.when(F.col("doc_hash").isNull(), "prune").when(same, "skip").otherwise("index").alias("action"))


def stats(planned: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a)
    return planned.agg(count("index").alias("indexed"), count("skip").alias("skipped"), count("prune").alias("pruned"))


def replace_notes(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of changed paths replaced by their new ones; a path without new rows is gone."""
    return old.join(changed.select("path").distinct(), "path", "left_anti").unionByName(new)


def error_sample(failures: DataFrame, most: int = 10) -> DataFrame:
    """n, sample: exact number of failures and the first few by path."""
    first = failures.orderBy("path").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "error"))), lambda e: F.concat(e["path"], F.lit(": "), e["error"])), "; ").alias("sample"))
    n = failures.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return n.join(first.withColumn("k", F.lit(1)), "k").select("n", F.when(F.col("n") > most, F.concat("sample", F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.col("sample")).alias("sample"))


def fingerprint(dim: int, prefix: str, version: int = 2) -> str:
    """Metadata that an index must match to be used."""
    return f"v{version}|dim={dim}|doc={prefix}"


def model_key(model: Column) -> Column:
    """Partition value of a model's index."""
    return F.substring(F.sha1(model.cast("binary")), 1, 12)
