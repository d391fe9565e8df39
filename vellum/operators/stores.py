"""Keyed tables: sessions, saved results, trash, names; batch outcomes are a status column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import trash_time


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """Last write of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in recency])
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prune_not_in(saved: DataFrame, kept: DataFrame, edited: DataFrame, keys: list[str], note: str) -> DataFrame:
    """saved without the rows of edited notes whose key isn't kept."""
    gone = saved.join(edited.select(note).distinct(), note, "left_semi").join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys)
    return saved.join(gone, keys, "left_anti")


def rename_prefix(rows: DataFrame, old: str, new: str, path: str, keys: list[str]) -> DataFrame:
    """Rows under folder old moved to new; a moved row wins over one that is there."""
    moved = F.startswith(F.col(path), F.lit(f"{old}/"))
    out = rows.withColumn("_moved", moved).withColumn(path, F.when(moved, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(F.col(path)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_moved"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_moved")


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti")


def bump(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions whose updated_at is that of their last turn."""
    last = turns.groupBy("session_id").agg(F.max("created_at").alias("_last")).withColumnRenamed("session_id", "id")
    return sessions.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def trash_listing(rows: DataFrame) -> DataFrame:
    """Trash entries with their name, path and time (rows: trash_id, rel); newest first is trash_id descending."""
    return rows.select("trash_id", F.col("rel").alias("original_path"), F.concat(F.lit(".trash/"), "trash_id", F.lit("/"), "rel").alias("trash_path"), F.element_at(F.split("rel", "/"), -1).alias("name"), trash_time(F.col("trash_id")).alias("deleted_at"))


def anchor_edit(body: Column, old: Column, new: Column) -> Column:
    """struct(status, body): old replaced by new where it stands exactly once."""
    count = F.when(old == "", F.lit(0)).otherwise(((F.char_length(body) - F.char_length(F.replace(body, old, F.lit("")))) / F.char_length(old)).cast("int"))
    status = F.when(count == 0, "not found").when(count > 1, "ambiguous").otherwise("edited")
    return F.struct(status.alias("status"), F.when(count == 1, F.replace(body, old, new)).otherwise(body).alias("body"))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links (link_id, target) with the path each leads to: first note in walk order with that path or name."""
    bare = F.lower(F.regexp_replace("path", r"(?i)\.(md|markdown)$", ""))
    keys = notes.select("path", F.split("path", "/").alias("walk"), F.explode(F.array_distinct(F.array(bare, F.element_at(F.split(bare, "/"), -1)))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by("path", "walk").alias("path"))
    wanted = F.lower(F.regexp_replace(F.trim("target"), r"(?i)\.(md|markdown)$", ""))
    path_key, name_key = wanted, F.element_at(F.split(wanted, "/"), -1)
    tried = links.select("link_id", "target", F.explode(F.array_distinct(F.array(path_key, name_key))).alias("key"))
    found = tried.join(first, "key").groupBy("link_id").agg(F.min_by("path", F.split("path", "/")).alias("path"))
    return links.join(found, "link_id", "left").select("link_id", "target", "path")


def tree(notes: DataFrame) -> DataFrame:
    """path, parent, depth, is_dir of all notes and the folders above them."""
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))
    return notes.select(F.explode(levels).alias("n")).select("n.*").groupBy("path", "parent", "depth").agg(F.max("is_dir").alias("is_dir"))


def choose_kernels(blocks: DataFrame, kernels: DataFrame) -> DataFrame:
    """blocks (block_id, lang) with the kernel that runs them: family, then newest version, vault before shared."""
    from vellum.functions.text import version_key

    claims = kernels.select("family", "version", "source", F.explode("match").alias("lang"))
    w = Window.partitionBy("lang").orderBy("family", F.desc(version_key(F.col("version"))), (F.col("source") != "vault"))
    best = claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return blocks.join(best, "lang", "left").select("block_id", "lang", "family", "version")
