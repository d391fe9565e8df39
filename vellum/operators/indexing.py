"""One pass of index maintenance: plan, chunk, embed what changed, replace it, prune, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import markdown as M
from vellum.operators import sync
from vellum.operators.chunking import chunk_notes
from vellum.operators.embedding import Embedder, embed_texts
from vellum.schema import ChunkOptions


@dataclass(frozen=True)
class Synced:
    """The new index; the plan; the counts; a sample of the failures. All lazy."""

    chunks: DataFrame
    plan: DataFrame
    stats: DataFrame
    errors: DataFrame


def chunk_rows(notes: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """path, idx, heading, text, embed_text, doc_hash of notes (path, body, doc_hash).

    The values of a note's properties stand before the text of its first chunk.
    """
    parts = notes.select("path", "doc_hash", M.note_body(F.col("body")).alias("body"), M.properties(M.frontmatter_block(F.col("body"))).alias("props"))
    values = F.array_join(F.flatten(F.transform("props", lambda p: p["values"])), " ")
    heads = parts.select("path", "doc_hash", values.alias("values"))
    rows = chunk_notes(parts, options).join(heads, "path")
    text = F.when((F.col("idx") == 0) & (F.col("values") != ""), F.concat("values", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    rows = rows.select("path", "idx", "heading", text.alias("text"), "doc_hash")
    return rows.withColumn("embed_text", M.embed_text(M.note_title(F.col("path")), F.col("heading"), F.col("text")))


def sync_notes(disk: DataFrame, index: DataFrame, embed: Embedder, options: ChunkOptions | None = None, force: bool = False, only: DataFrame | None = None, concurrency: int | None = None) -> Synced:
    """Bring an index (path, idx, heading, text, doc_hash, embedding) up to the notes (path, body, doc_hash).

    Notes whose hash is the stored one never reach the chunker or the embedder. A note of which any
    chunk fails keeps its old rows and is counted as failed; the others go on. only: the paths to
    look at, where others are neither indexed nor pruned. A note without text has no rows, so it is
    looked at again each time.
    """
    if only is not None:
        wanted = only.select("path").distinct()
        disk = disk.join(wanted, "path", "left_semi")
        stored = index.join(wanted, "path", "left_semi").select("path", "doc_hash")
    else:
        stored = index.select("path", "doc_hash")
    planned = sync.plan(disk, stored, force)
    todo = disk.join(planned.where("action = 'index'").select("path"), "path", "left_semi")
    done = embed_texts(chunk_rows(todo, options), embed, "embed_text", concurrency)
    errors = done.where("error is not null").groupBy("path").agg(F.min_by("error", "idx").alias("error"))
    fresh = done.join(errors.select("path"), "path", "left_anti").select("path", "idx", "heading", "text", "doc_hash", "embedding")
    replaced = planned.where("action <> 'skip'").join(errors.select("path"), "path", "left_anti")
    chunks = sync.replace_notes(index.select("path", "idx", "heading", "text", "doc_hash", "embedding"), replaced, fresh)
    outcome = planned.join(errors.select("path", F.lit("failed").alias("_failed")), "path", "left").withColumn("action", F.coalesce("_failed", "action"))
    counts = [F.count_if(F.col("action") == a).alias(n) for a, n in (("index", "indexed"), ("skip", "skipped"), ("prune", "pruned"), ("failed", "failed"))]
    return Synced(chunks, planned, outcome.agg(*counts), sync.error_sample(errors))


def write_index(chunks: DataFrame, root: str, model: str, vault: str, snapshot: str) -> str:
    """Write an index as a snapshot of its own; whoever reads takes the path that this returns.

    The old snapshot is still whole while the new one is written, and nothing is replaced in place.
    """
    key = chunks.sparkSession.range(1).select(sync.model_key(F.lit(model))).first()[0]
    path = f"{root.rstrip('/')}/model={key}/vault={vault}/snapshot={snapshot}"
    chunks.sortWithinPartitions("path", "idx").write.mode("errorifexists").parquet(path)
    return path
