"""Runs as a stream: pending and saved results by note and block, and output until its terminal event.

State is kept by key, so a restart goes on where the checkpoint ends. Both need the state store that
Spark keeps on disk (RocksDB) and the events of a key in order from batch to batch; inside a batch
they are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "note_path string, block_hash string, saved string, pending string"
DONE = "run_id string, text string, exit_code int, dur_ms long"


def use_disk_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def next_state(saved: str | None, pending: str | None, kind: str, result: str | None) -> tuple[str | None, str | None]:
    """A run is saved where nothing is, else it is pending; save makes the pending run the saved one."""
    if kind == "run":
        return (result, None) if saved is None else (saved, result)
    if kind == "save":
        return (pending, None) if pending is not None else (saved, None)
    if kind == "discard":
        return saved, None
    return (None, None) if kind == "delete" else (saved, pending)


class PendingAndSaved(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("results", "saved string, pending string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        saved, pending = self.state.get() if self.state.exists() else (None, None)
        for r in sorted(rows, key=lambda r: r["ord"]):
            saved, pending = next_state(saved, pending, r["type"], r["result"])
        if saved is None and pending is None:
            self.state.clear()
        else:
            self.state.update((saved, pending))
        yield Row(note_path=key[0], block_hash=key[1], saved=saved, pending=pending)

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame) -> DataFrame:
    """STATE after each micro-batch, for the keys that it touches (note_path, block_hash, ord, type, result).

    The last row of a key is what `runs.settle` gives for all events; a deleted key's is all null.
    """
    use_disk_state(events.sparkSession)
    rows = events.select("note_path", "block_hash", F.col("ord").cast("long").alias("ord"), "type", "result")
    return rows.groupBy("note_path", "block_hash").transformWithState(PendingAndSaved(), STATE, "Update", "None")


class OutputUntilDone(StatefulProcessor):
    """Collects a run's output; events after its terminal one are stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "data string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        for r in sorted(rows, key=lambda r: r["ord"]):
            if r["type"] == "output":
                self.parts.appendValue((r["data"] or "",))
            elif r["type"] == "done":
                text = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
                self.parts.clear()
                self.done.update((True,))
                yield Row(run_id=key[0], text=text, exit_code=r["code"], dur_ms=r["dur_ms"])
                return

    def close(self) -> None:
        pass


def complete_runs_stream(events: DataFrame) -> DataFrame:
    """DONE of every run, once its terminal event has come (run_id, ord, type, data, code, dur_ms)."""
    use_disk_state(events.sparkSession)
    rows = events.select(F.col("run_id").cast("string").alias("run_id"), F.col("ord").cast("long").alias("ord"), "type", "data", F.col("code").cast("int").alias("code"), F.col("dur_ms").cast("long").alias("dur_ms"))
    return rows.groupBy("run_id").transformWithState(OutputUntilDone(), DONE, "Update", "None")
