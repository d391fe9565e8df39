"""File changes: debounce per note, in batch and as a stream, and the sync it triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a note that saw no event for so long is synced.
QUIET = "500 milliseconds"


def classify(op: Column, path: Column, is_dir: Column) -> Column:
    """vault: the whole vault is looked at again; note: this note; ignore: neither."""
    markdown = F.lower(path).rlike(r"\.(md|markdown)$")
    bare = ~F.element_at(F.split(path, "/"), -1).rlike(r"\.")
    return F.when((op == "create") & is_dir, "vault").when(op.isin("rename", "remove") & (is_dir | bare), "vault").when(markdown, "note").otherwise("ignore")


def debounced(events: DataFrame, quiet: str = QUIET, key: str = "path") -> DataFrame:
    """key, first, last, n: events of a key no further apart than the quiet time are one change."""
    spans = events.groupBy(key, F.session_window("ts", quiet)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return spans.select(key, "first", "last", "n")


def debounce_stream(events: DataFrame, quiet: str = QUIET, late: str = "30 minutes", key: str = "path") -> DataFrame:
    """The same on a stream; a change is given out once the watermark has passed its quiet time."""
    return debounced(events.withWatermark("ts", late), quiet, key)


def sync_on_changes(changes: DataFrame, sync_vault: Callable[[], None], sync_notes: Callable[[DataFrame], None], checkpoint: str):
    """Start a stream that syncs changed notes (kind note), or once the vault where any change asks for it."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.where("kind = 'vault'").limit(1).count():
            sync_vault()
        else:
            sync_notes(batch.where("kind = 'note'").select("path").distinct())

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_runs(events: DataFrame) -> DataFrame:
    """run_id, text, exit_code, dur_ms of runs that have their terminal event (run_id, ord, type, data, code, dur_ms)."""
    done = events.where("type = 'done'").groupBy("run_id").agg(F.min("ord").alias("end"), F.min_by("code", "ord").alias("exit_code"), F.min_by("dur_ms", "ord").alias("dur_ms"))
    out = events.where("type = 'output'").join(done.select("run_id", "end"), "run_id").where(F.col("ord") < F.col("end"))
    text = out.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "data"))), lambda r: r["data"]), "").alias("text"))
    return done.join(text, "run_id", "left").select("run_id", F.coalesce("text", F.lit("")).alias("text"), "exit_code", "dur_ms")
