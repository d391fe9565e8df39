"""A store of notes' chunks whose keyword index follows them, and the index pass that maintains it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import sync
from vellum.operators.embedding import Embedder, embed_texts
from vellum.operators.indexing import chunk_rows
from vellum.operators.keyword_index import KeywordIndex
from vellum.schema import ChunkOptions
from vellum.shared import materialize

CHUNK = "vault string, id long, path string, idx int, heading string, text string, doc_hash string, embedding array<float>"


class Store(Protocol):
    """What an index pass needs of a store."""

    def doc_hashes(self) -> DataFrame:
        """path, doc_hash of every stored note."""

    def replace(self, changed: DataFrame, chunks: DataFrame) -> None:
        """The chunks (CHUNK without vault and id) of the changed notes (path) in place of all that they had."""


class NoteStore(KeywordIndex):
    """Chunks with vectors beside their keyword index, in the same segments: one entry commits both.

    Ids are given here. A segment's chunks are numbered by hash group, so no task numbers them all.
    """

    GROUPS = 1024

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> NoteStore:
        """An empty store in a new folder."""
        store = cls(spark, root)
        store._put(0, spark.createDataFrame([], CHUNK), None)
        return store

    def chunks(self) -> DataFrame:
        """CHUNK of the live chunks."""
        return self._live("chunks", CHUNK).drop("segment")

    def doc_hashes(self) -> DataFrame:
        return self.chunks().select("path", "doc_hash").distinct()

    def paths(self) -> DataFrame:
        return self.chunks().select("path").distinct()

    def replace(self, changed: DataFrame, chunks: DataFrame, vault: str = "") -> None:
        last = self.chunks().agg(F.max("id")).first()[0]
        group = F.pmod(F.xxhash64("path", "idx"), F.lit(self.GROUPS))
        nth = F.row_number().over(Window.partitionBy("_group").orderBy("path", "idx")).cast("long") - 1
        numbered = chunks.withColumn("_group", group).withColumn("id", F.lit(-1 if last is None else last) + 1 + nth * self.GROUPS + F.col("_group"))
        # Written before anything is built from it: ids are the same for chunks and postings.
        fresh = materialize(numbered.select(F.lit(vault).alias("vault"), "id", "path", F.col("idx").cast("int").alias("idx"), "heading", "text", "doc_hash", "embedding"), "chunks")
        gone = self._sizes().where(F.col("vault") == vault).join(changed.select("path").distinct(), "path", "left_semi")
        self._put(max(self.segments()) + 1, fresh, gone.select(F.col("segment").alias("of"), "id"))

    def delete(self, notes: DataFrame) -> None:
        self.replace(notes, self.spark.createDataFrame([], CHUNK).drop("vault", "id"))

    def _put(self, segment: int, chunks: DataFrame, gone: DataFrame | None) -> None:
        chunks.write.mode("overwrite").parquet(f"{self.root}/chunks/segment={segment}")
        self._write(segment, chunks, gone)


@dataclass(frozen=True)
class Counts:
    """Notes indexed, skipped, pruned and failed; chunks written; and a sample of the failures."""

    indexed: int
    skipped: int
    pruned: int
    failed: int
    chunks: int
    errors: str | None


def sync_store(store: Store, disk: DataFrame, embed: Embedder, options: ChunkOptions | None = None, force: bool = False, concurrency: int | None = None) -> Counts:
    """Bring a store up to the notes (path, body, doc_hash) and tell what was done.

    The counts are observed on the passes that write; nothing is worked out a second time for them.
    A note of which any chunk fails keeps what it had.
    """
    planned_, made = Observation(), Observation()
    planned = sync.plan(disk, store.doc_hashes(), force)
    planned = materialize(planned.observe(planned_, *[F.count_if(F.col("action") == a).alias(a) for a in ("index", "skip", "prune")]), "sync-plan")
    todo = disk.join(planned.where("action = 'index'").select("path"), "path", "left_semi")
    done = embed_texts(chunk_rows(todo, options), embed, "embed_text", concurrency)
    done = materialize(done.observe(made, F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")), "sync-chunks")
    failed, lost, sample = 0, 0, None
    fresh, replaced = done.where("error is null"), planned.where("action <> 'skip'").select("path")
    if made.get["bad"]:
        errors = done.groupBy("path").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("idx"))).alias("error"), F.count_if(F.col("error").isNull()).alias("good")).where("error is not null")
        told = sync.error_sample(errors).first()
        failed, sample, lost = told["n"], told["sample"], errors.agg(F.sum("good")).first()[0]
        fresh, replaced = fresh.join(errors.select("path"), "path", "left_anti"), replaced.join(errors.select("path"), "path", "left_anti")
    store.replace(replaced, fresh.select("path", "idx", "heading", "text", "doc_hash", "embedding"))
    p = planned_.get
    return Counts(p["index"] - failed, p["skip"], p["prune"], failed, made.get["good"] - lost, sample)
