"""The engine's tables, read from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.keyword_index import KeywordIndex
from vellum.shared import fresh_path


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, vault, path, body, doc_hash of the documents."""
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", F.col("lang").alias("vault"), path.alias("path"), F.col("text").alias("body"), F.sha2(F.col("text").cast("binary"), 256).alias("doc_hash"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents and vectors: five make a note, notes are dealt to four vaults and two models.

    A document without a vector has a null embedding, a vector without a document no text.
    """
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    rows = table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "full").withColumn("_id", F.coalesce("vec_id", "doc_id"))
    note = F.floor(F.col("_id") / 5)
    vault = note % 4
    return rows.select(
        F.col("_id").alias("id"), note.alias("note"), F.concat(F.lit("v"), vault.cast("string")).alias("vault"), F.concat(F.lit("m"), F.floor(vault / 2).cast("string")).alias("model"),
        F.concat(F.lit("note-"), note.cast("string"), F.lit(".md")).alias("path"), (F.col("_id") % 5).cast("int").alias("idx"), F.col("lang").alias("heading"), "text", "embedding", "label",
    )


def vector_queries(found: DataFrame) -> DataFrame:
    """qid, own, vec: every chunk whose id is divisible by 20 asks for its neighbours."""
    return found.where((F.col("id") % 20 == 0) & F.col("embedding").isNotNull()).select(F.col("id").alias("qid"), F.col("id").alias("own"), F.col("embedding").alias("vec"))


def hybrid_queries(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Every benchmark passage with the vector of chunk 20 times its number (null beyond the last)."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    vectors = found.select((F.col("id") / 20).alias("_n"), F.col("id").alias("own"), F.col("embedding").alias("vec"))
    return asked.join(vectors, F.col("qid") == F.col("_n"), "left").select("qid", "query", "own", "vec")


def keyword_index(spark: SparkSession, d: str) -> KeywordIndex:
    """The chunks' keyword index, written to the shared folder."""
    return KeywordIndex.build(chunks(spark, d), fresh_path(spark, "keyword-index"))


def sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of the conversations; a turn's second counts on from its session's start."""
    rows = table(spark, d, "conversations")
    turns = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("role").alias("kind"), F.col("text").alias("query"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))
    heads = turns.groupBy(F.col("session_id").alias("id")).agg(F.min_by("query", "id").alias("first"), F.min("created_at").alias("created_at"))
    return heads.withColumn("updated_at", F.col("created_at")), turns


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run results of the events: note of the user, block of the properties' digest."""
    return table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/n.md")).alias("note_path"), F.sha2(F.coalesce("props", F.lit("")).cast("binary"), 256).alias("block_hash"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
