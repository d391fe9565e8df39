"""Table functions for SQL: SELECT ... FROM notes, LATERAL note_links(body)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vellum.functions.links import links_in
from vellum.functions.markdown import code_blocks_of
from vellum.operators.chunking import chunks_of
from vellum.schema import ChunkOptions


class NoteLinks:
    def eval(self, body: str) -> Iterator[tuple]:
        for n, (target, heading, label) in enumerate(links_in(body or "")):
            yield n, target, heading, label


class NoteCode:
    def eval(self, body: str) -> Iterator[tuple]:
        for b in code_blocks_of(body or ""):
            yield b["idx"], b["lang"], b["kernel"], b["version"], b["code"]


class NoteChunks:
    def eval(self, body: str) -> Iterator[tuple]:
        for n, (heading, text) in enumerate(chunks_of(body or "", ChunkOptions().settled())):
            yield n, heading, text


def register(spark: SparkSession) -> None:
    """note_links(body), note_code(body) and note_chunks(body), null bodies giving no rows.

    Bodies and rows travel in Arrow batches, but each body is handled by itself in Python: meant for
    SQL over some notes; columns of `functions` do the same work on whole vaults.
    """
    spark.udtf.register("note_links", udtf(NoteLinks, returnType="n int, target string, heading string, label string", useArrow=True))
    spark.udtf.register("note_code", udtf(NoteCode, returnType="idx int, lang string, kernel string, version string, code string", useArrow=True))
    spark.udtf.register("note_chunks", udtf(NoteChunks, returnType="idx int, heading string, text string", useArrow=True))
