"""Stored keyword index: postings by term, kept up by segments as notes change.

A posting is a term in a chunk: how often it stands in each column, the gaps between its places
there, and the chunk's number of terms. Postings lie in folders by segment and hash of the term, and
are sorted by term inside a file, so a search reads the folders of its terms only and, for terms
that stand alone, no places. An update writes one more segment: the new chunks, and the numbers of
those that the changed or removed notes had before. A segment counts once its entry under
`committed` is there, which is written last; nothing is ever changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.shared import materialize

COLUMNS = ("path", "heading", "text")
#: Folders that terms are dealt to; chunks whose terms a task sorts at once.
BUCKETS, PASS = 64, 1024
POSTING = "vault string, term string, id long, len int, tfs array<int>, gaps array<array<int>>"
#: A row with null term is a chunk of its own (SIZE); such rows lie in the folder SIZES.
ROW, SIZES = f"{POSTING}, path string, idx int", -1
SIZE = "vault string, id long, path string, idx int, len int"


def bucket_of(term: str) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


@dataclass(frozen=True)
class Postings:
    """Postings (POSTING, maybe with bucket) and sizes (SIZE) of the live chunks."""

    rows: DataFrame
    sizes: DataFrame

    def of_terms(self, terms: DataFrame) -> Postings:
        """These, from the folders of these terms (term) only; at most BUCKETS numbers come to the driver."""
        if "bucket" not in self.rows.columns:
            return self
        wanted = [r[0] for r in terms.select(bucket_of("term")).distinct().collect()]
        return Postings(self.rows.where(F.col("bucket").isin(wanted)).drop("bucket"), self.sizes)


def _terms(chunks: DataFrame) -> DataFrame:
    vault = F.coalesce(F.col("vault").cast("string"), F.lit("")) if "vault" in chunks.columns else F.lit("")
    return chunks.select(vault.alias("vault"), F.col("id").cast("long").alias("id"), *[T.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(COLUMNS)], F.col("path"), F.col("idx").cast("int").alias("idx"))


def posting_rows(chunks: DataFrame) -> DataFrame:
    """ROW of chunks (id, path, idx, heading, text, maybe vault): its postings, and one row for the chunk itself.

    Built where the chunk is, without a shuffle.
    """
    n = len(COLUMNS)

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PASS):
                batch = whole.slice(lo, PASS)
                sizes = [pc.fill_null(pc.list_value_length(batch.column(2 + c)), 0).to_numpy() for c in range(n)]
                terms = pa.concat_arrays([batch.column(2 + c).flatten() for c in range(n)]).dictionary_encode()
                code = terms.indices.to_numpy()
                row = np.concatenate([np.repeat(np.arange(batch.num_rows), s) for s in sizes])
                col = np.repeat(np.arange(n), [s.sum() for s in sizes])
                place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
                order = np.lexsort((place, col, code, row))
                row, code, col, place = row[order], code[order], col[order], place[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                fresh = new.copy()
                fresh[1:] |= col[1:] != col[:-1]
                gaps = place.copy()
                gaps[1:] -= np.where(fresh[1:], 0, place[:-1])
                posting = np.cumsum(new) - 1
                tfs = np.bincount(posting * n + col, minlength=n * int(new.sum()))
                at = row[new]
                names = ["vault", "term", "id", "len", "tfs", "gaps", "path", "idx"]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)), terms.dictionary.take(pa.array(code[new])), batch.column(1).take(pa.array(at)), pa.array(sum(sizes)[at].astype(np.int32)),
                        lists(tfs, np.full(len(at), n)), lists(lists(gaps, tfs), np.full(len(at), n)), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int32()),
                    ],
                    names=names,
                )
                none = [pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), none[0], batch.column(1), pa.array(sum(sizes).astype(np.int32)), none[1], none[2], batch.column(2 + n), batch.column(3 + n)], names=names)

    return _terms(chunks).select("vault", "id", *[f"t{i}" for i in range(n)], "path", "idx").mapInArrow(run, ROW)


def _split(rows: DataFrame) -> Postings:
    return Postings(rows.where("term is not null").drop("path", "idx"), rows.where("term is null").select(*[c.split()[0] for c in SIZE.split(", ")]))


def postings_of(chunks: DataFrame) -> Postings:
    """Postings that are worked out anew wherever they are read."""
    return _split(posting_rows(chunks))


def postings_for(chunks: DataFrame, terms: DataFrame) -> Postings:
    """Postings of these terms (term, distinct; placed: whether their places are wanted) and the sizes of all chunks.

    Written once where the chunks are, without a shuffle, for searches that need no index afterwards.
    """
    told = terms.select("term", "placed").unionByName(terms.sparkSession.sql("SELECT CAST(NULL AS STRING) AS term, false AS placed")).withColumnRenamed("term", "_term")
    rows = posting_rows(chunks)
    rows = rows.join(told, F.col("term").eqNullSafe(F.col("_term"))).withColumn("gaps", F.when(F.col("placed"), F.col("gaps")))
    return _split(materialize(rows.select(*[c.split()[0] for c in ROW.split(", ")]), "asked-postings"))


class KeywordIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, root: str) -> KeywordIndex:
        """A new index of chunks (id, path, idx, heading, text, maybe vault); ids are unique."""
        index = cls(chunks.sparkSession, root)
        index._write(0, chunks, None)
        return index

    def update(self, changed: DataFrame, chunks: DataFrame) -> int:
        """Replace all chunks of the changed notes (path, maybe vault) by these; a note without chunks is gone.

        Returns the new segment's number. An id may come again where its old chunk goes.
        """
        vault = F.coalesce(F.col("vault").cast("string"), F.lit("")) if "vault" in changed.columns else F.lit("")
        gone = self._sizes().join(changed.select(vault.alias("vault"), "path").distinct(), ["vault", "path"], "left_semi").select(F.col("segment").alias("of"), "id")
        segment = max(self.segments()) + 1
        self._write(segment, chunks, gone)
        return segment

    def compact(self, root: str) -> KeywordIndex:
        """The live rows as one segment in another folder."""
        fresh = KeywordIndex(self.spark, root)
        fresh._store(0, self._live("postings", f"{ROW}, bucket int").drop("segment"), None)
        return fresh

    def segments(self) -> list[int]:
        return [r[0] for r in self.spark.read.schema("segment int").parquet(f"{self.root}/committed").collect()]

    def postings(self) -> Postings:
        rows = self._live("postings", f"{ROW}, bucket int")
        sizes = rows.where(F.col("bucket") == SIZES).select(*[c.split()[0] for c in SIZE.split(", ")])
        return Postings(rows.where(F.col("bucket") != SIZES).drop("segment", "path", "idx"), sizes)

    def _sizes(self) -> DataFrame:
        """SIZE and segment of the live chunks."""
        return self._live("postings", f"{ROW}, bucket int").where(F.col("bucket") == SIZES)

    def _live(self, part: str, schema: str, segments: list[int] | None = None) -> DataFrame:
        """Rows of the committed segments whose chunk wasn't replaced by a later one."""
        segments = segments or self.segments()
        read = lambda p, s: self.spark.read.schema(f"{s}, segment int").parquet(f"{self.root}/{p}").where(F.col("segment").isin(segments))
        if segments == [0]:
            return read(part, schema)
        gone = read("gone", "of int, id long").select(F.col("of").alias("segment"), "id")
        return read(part, schema).join(gone, ["segment", "id"], "left_anti")

    def _write(self, segment: int, chunks: DataFrame, gone: DataFrame | None) -> None:
        self._store(segment, posting_rows(chunks).select("*", F.when(F.col("term").isNull(), SIZES).otherwise(bucket_of("term")).alias("bucket")), gone)

    def _store(self, segment: int, postings: DataFrame, gone: DataFrame | None) -> None:
        # A bucket has as many files as there are tasks for it, so a term that is everywhere is dealt to all of them.
        tasks = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        spread = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(tasks))).sortWithinPartitions("bucket", "term", "id")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.root}/gone/segment={segment}")
        self.spark.range(1).select(F.lit(segment).alias("segment")).coalesce(1).write.mode("append").parquet(f"{self.root}/committed")
