"""Code-block runs: pending and saved results, and running a note's blocks up to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(events: DataFrame, keys: list[str] = ("note_path", "block_hash"), order: list[str] = ("ord",)) -> DataFrame:
    """keys, saved, pending: results after all events (type run, save, discard, delete; result).

    A run without a saved result is saved at once; with one it is pending and takes the place of
    the pending run before it. save makes the pending run the saved one, discard drops it, delete
    drops both. So a run counts as saved if it is the first since the last delete or if save is the
    next event, and as pending if it is the last event; two windows over one partitioning tell it.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    life = F.sum((F.col("type") == "delete").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.select(*keys, *order, "type", "result", life.alias("_life")).where("type <> 'delete'")
    one = Window.partitionBy(*keys, "_life").orderBy(*order)
    runs = F.sum((F.col("type") == "run").cast("int")).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_nth", runs).withColumn("_next", F.lead("type").over(one))
    rows = rows.withColumn("_last", F.max("_life").over(Window.partitionBy(*keys)))
    deleted = events.where("type = 'delete'").groupBy(*keys).agg(F.count("*").cast("long").alias("_lives"))
    alive = rows.where("type = 'run' AND _life = _last").join(deleted, list(keys), "left").where("_life = coalesce(_lives, 0)")
    place = F.struct(*order)
    saved = F.when((F.col("_nth") == 1) | (F.col("_next") == "save"), place)
    pending = F.when((F.col("_nth") > 1) & F.col("_next").isNull(), place)
    return alive.groupBy(*keys).agg(F.max_by("result", saved).alias("saved"), F.max_by("result", pending).alias("pending"))


def run_above(blocks: DataFrame, claimed: DataFrame, outcomes: DataFrame, upto: DataFrame) -> DataFrame:
    """note_path, idx, state of the blocks up to the one asked for: skipped, done, failed, not run.

    blocks: note_path, idx, lang; claimed: lang; outcomes: note_path, idx, exit_code; upto:
    note_path, idx. Languages that no kernel claims are skipped; the first failure stops the rest.
    """
    wanted = blocks.join(upto.select("note_path", F.col("idx").alias("_upto")), "note_path").where("idx <= _upto").drop("_upto")
    known = wanted.join(claimed.select("lang").distinct().withColumn("_claimed", F.lit(True)), "lang", "left").join(outcomes, ["note_path", "idx"], "left")
    failed = F.col("_claimed") & (F.col("exit_code") != 0)
    first = F.min(F.when(failed, F.col("idx"))).over(Window.partitionBy("note_path"))
    state = F.when(F.col("_claimed").isNull(), "skipped").when(F.col("idx") > F.col("_first"), "not run").when(failed, "failed").when(F.col("exit_code").isNull(), "not run").otherwise("done")
    return known.withColumn("_first", first).select("note_path", "idx", "lang", state.alias("state"))


def rehydrate(blocks: DataFrame, saved: DataFrame) -> DataFrame:
    """Blocks (note_path, idx, block_hash) with the result saved for the same code in the same note."""
    return blocks.join(saved, ["note_path", "block_hash"], "left")


def sweep_orphans(saved: DataFrame, notes: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """saved without results of notes that are gone; notes whose state is unknown keep theirs."""
    there = notes.select("note_path") if unknown is None else notes.select("note_path").unionByName(unknown.select("note_path"))
    return saved.join(there.distinct(), "note_path", "left_semi")
