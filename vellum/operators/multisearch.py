"""Search across vaults: one group per embedding model, since similarities compare only within one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.keyword_index import Postings, postings_of
from vellum.operators.search import band, drop_adjacent, fuse, keyword_leg, vector_leg
from vellum.schema import SearchOptions


def merged_vectors(queries: DataFrame, chunks: DataFrame, options: SearchOptions) -> DataFrame:
    """Vector legs of all vaults of a model ranked together, banded once per query and model."""
    legs = vector_leg(queries, chunks, options, ["model", "vault"])
    order = Window.partitionBy("qid", "model").orderBy(F.desc("sim"), "vault", "id")
    return band(legs.withColumn("rn", F.row_number().over(order)), options, ["qid", "model"])


def interleaved_keywords(queries: DataFrame, chunks: DataFrame, posted: Postings, options: SearchOptions) -> DataFrame:
    """Keyword legs of the vaults by rank, then vault: everyone's first, everyone's second, and so on.

    Each vault is an index of its own, all of them in one plan.
    """
    leg = keyword_leg(queries, posted, options, ["vault"]).join(chunks.select("id", "model"), "id")
    order = Window.partitionBy("qid", "model").orderBy("rn", "vault")
    return leg.select("qid", "model", "vault", "id", F.row_number().over(order).alias("rn"))


def model_groups(queries: DataFrame, chunks: DataFrame, options: SearchOptions | None = None, posted: Postings | None = None) -> DataFrame:
    """qid, group_pos, model, pos, vault, id, path, idx, score: groups by their best score, hits inside.

    Every query asks all vaults and models.
    """
    options = options or SearchOptions()
    posted = posted or postings_of(chunks)
    fused = fuse(merged_vectors(queries, chunks, options), interleaved_keywords(queries, chunks, posted, options), chunks, options, ["qid", "model"])
    hits = drop_adjacent(fused, ["qid", "model"], ("vault", "path")).where(F.col("final") <= options.depth)
    top = F.max("score").over(Window.partitionBy("qid", "model"))
    hits = hits.withColumn("best", top)
    place = F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("best"), "model"))
    return hits.select("qid", place.alias("group_pos"), "model", F.col("final").alias("pos"), "vault", "id", "path", "idx", "score")


def runs_of(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of consecutive equal values: by, run, value, first, last, n."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    numbered = rows.withColumn("_start", starts).withColumn("run", F.sum("_start").over(w).cast("int"))
    return numbered.groupBy(by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
