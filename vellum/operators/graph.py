"""Similarity graph over notes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vellum.functions.vectors import unit
from vellum.operators.search import ROW_BLOCK, nearest
from vellum.schema import GraphOptions


#: Notes whose sums a task holds before it gives them out.
HELD = 4096


def centroids(chunks: DataFrame) -> DataFrame:
    """note, u: mean of a note's chunk vectors, scaled to length 1; notes with a zero mean are left out.

    A task sums the vectors it reads by note, so a note sends a few sums on, whatever its size. The
    vectors of a note are all of one length; null ones don't count.
    """
    note = chunks.schema["note"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(sums), to_arrow_type(note)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["note", "s"])
            sums.clear()
            return rows

        for batch in batches:
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                have = sums.get(n)
                if have is None:
                    sums[n] = x
                else:
                    have += x
            if len(sums) > HELD:
                yield out()
        if sums:
            yield out()

    part = chunks.select("note", "embedding").where("embedding is not null").mapInArrow(run, StructType([StructField("note", note), StructField("s", ArrayType(DoubleType()))]))
    whole = part.groupBy("note").agg(F.collect_list("s").alias("l")).select("note", F.aggregate(F.slice("l", 2, F.size("l")), F.col("l")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("v"))
    return whole.select("note", unit(F.col("v")).alias("u")).where("u is not null")


#: Groups that the notes are dealt to by nearness, so that far ones needn't meet: a root of the notes, at most so many.
MOST_CENTRES = 1024


def knn_edges(notes: DataFrame, options: GraphOptions | None = None) -> DataFrame:
    """a, b, weight with a < b: union of every note's k (one at least) nearest above the floor; notes: id, u.

    Every note is a query, so groups of near notes that the floor keeps apart are left out, exactly.
    """
    options = options or GraphOptions()
    n = notes.count()
    centres = min(MOST_CENTRES, math.isqrt(n // 16)) if n > ROW_BLOCK else 1  # one block meets itself anyway
    picks = nearest(notes.select(F.col("id").alias("qid"), F.col("id").alias("own"), "u"), notes, max(options.k, 1), options.min_sim, centres=centres)
    return picks.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.max("sim").alias("weight"))


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every note, 0 where it has no edge."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return notes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
