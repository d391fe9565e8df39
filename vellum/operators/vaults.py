"""Registries: known vaults, search targets, packages and their installed versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.semver import covers, is_release, is_version, precedence


def vault_key(path: Column, case_sensitive: bool = True) -> Column:
    """Identity of a vault: its path without empty and . segments and without a final slash."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    clean = F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))
    return clean if case_sensitive else F.lower(clean)


def register(recorded: DataFrame, added: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """recorded and added vaults (ord, path), each key once, at its first place; blank lines don't count."""
    rows = recorded.select("ord", "path", F.lit(0).alias("_new")).unionByName(added.select("ord", "path", F.lit(1).alias("_new")))
    rows = rows.withColumn("path", F.trim("path")).where("path <> ''").withColumn("_key", vault_key(F.col("path"), case_sensitive))
    first = Window.partitionBy("_key").orderBy("_new", "ord")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    end = recorded.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_end"))
    return kept.join(F.broadcast(end)).select((F.when(F.col("_new") == 1, F.col("_end") + F.col("ord")).otherwise(F.col("ord"))).alias("ord"), "path")


def forget(recorded: DataFrame, gone: DataFrame, case_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(recorded without the gone vaults, one row with the most recently recorded survivor as last)."""
    key = lambda d: d.withColumn("_key", vault_key(F.trim("path"), case_sensitive))
    left = key(recorded).join(key(gone).select("_key").distinct(), "_key", "left_anti").select("ord", "path")
    return left, left.agg(F.max_by("path", "ord").alias("last"))


def search_targets(live: DataFrame, known: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Vaults to search (path): those that run and those on record and available, each once, live first."""
    rows = live.select("path", F.lit(0).alias("_t")).unionByName(known.where("available").select("path", F.lit(1).alias("_t")))
    rows = rows.withColumn("_key", vault_key(F.col("path"), case_sensitive))
    return rows.groupBy("_key").agg(F.min_by("path", F.struct("_t", "path")).alias("path")).select("path")


def package_catalogue(packages: DataFrame, installed: DataFrame) -> DataFrame:
    """packages (family, version, ...) with whether that very version is installed."""
    have = installed.select("family", "version").distinct().withColumn("installed", F.lit(True))
    return packages.join(have, ["family", "version"], "left").withColumn("installed", F.col("installed").isNotNull())


def newest_installable(packages: DataFrame, pins: DataFrame) -> DataFrame:
    """family, version: the greatest version with an artifact for any platform; a pinned family only at its pin.

    packages: family, version, artifacts; pins: family, pin. A pin that isn't the newest gives no row.
    """
    best = packages.where(F.array_contains("artifacts", "any")).groupBy("family").agg(F.max_by("version", precedence(F.col("version"))).alias("version"))
    return best.join(pins, "family", "left").where("pin IS NULL OR pin = version").select("family", "version")


def resolve_packages(packages: DataFrame, asked: DataFrame) -> DataFrame:
    """family, core, pin, version, reason of asked (family, core, pin) packages.

    packages: family, version, range, artifacts. For a core that is a released version: the greatest
    version with an artifact for any platform whose range covers it, or the pinned one if it does.
    Any other core can't be checked: the greatest version, and a pin must be that. reason tells why
    version is null.
    """
    wanted = asked.select("family", "core", "pin").distinct()
    usable = packages.where(F.array_contains("artifacts", "any") & is_version(F.col("version"))).select("family", "version", "range").distinct()
    met = wanted.where(is_release(F.col("core"))).join(usable, "family").where(covers(F.col("range"), F.col("core")) & (F.col("pin").isNull() | (F.col("pin") == F.col("version"))))
    checked = met.groupBy("family", "core", "pin").agg(F.max_by("version", precedence(F.col("version"))).alias("version"))
    newest = usable.groupBy("family").agg(F.max_by("version", precedence(F.col("version"))).alias("version"))
    free = wanted.where(~is_release(F.col("core"))).join(newest, "family").where("pin IS NULL OR pin = version").select("family", "core", "pin", "version")
    found = checked.unionByName(free).withColumn("_pin", F.coalesce("pin", F.lit(""))).drop("pin")
    known = packages.select("family").distinct().withColumn("_known", F.lit(True))
    rows = wanted.withColumn("_pin", F.coalesce("pin", F.lit(""))).join(found, ["family", "core", "_pin"], "left").join(known, "family", "left")
    reason = F.when(F.col("version").isNotNull(), F.lit(None).cast("string")).when(F.col("_known").isNull(), "no such package").when(F.col("pin").isNotNull(), "no such version").otherwise("no installable version")
    return rows.select("family", "core", "pin", "version", reason.alias("reason"))


def adopt_settings(values: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows (key, value, updated_at): the latest value of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("value"))
    return values.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attachments(have: DataFrame, incoming: DataFrame) -> DataFrame:
    """name, outcome of incoming files (name, content): new, same bytes, or conflict, where the old stays."""
    old = have.select("name", F.sha2("content", 256).alias("_old"))
    rows = incoming.select("name", F.sha2("content", 256).alias("_new")).join(old, "name", "left")
    return rows.select("name", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "same").otherwise("conflict").alias("outcome"))
