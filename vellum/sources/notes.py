"""Notes from folders, and the routing of files to import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.markdown import is_markdown


def walk_vault(spark: SparkSession, root: str) -> DataFrame:
    """path, body, doc_hash of the Markdown files under root.

    Spark's file listing leaves out files and folders whose names start with . or _.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cut = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/+", "/")
    full = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    rel = F.substring(full, F.char_length(cut) + 2, F.char_length(full))
    rows = files.select(rel.alias("path"), "content").where(is_markdown(F.col("path")))
    return rows.select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("doc_hash"))


def import_route(name: Column, size: Column, most: int = 64 << 20, has_model: bool = False) -> Column:
    """struct(converter, code): how a file is converted, or why not."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    converter = (
        F.when(ext.isin("md", "markdown"), "markdown").when(ext == "txt", "text").when(ext.isin("html", "htm"), "html")
        .when(ext == "docx", "docx").when(ext == "odt", "odt").when(ext == "pdf", "pdf")
    )
    code = F.when(converter.isNull(), "unsupported").when(size > most, "too-large").when((converter == "pdf") & F.lit(not has_model), "no-convert-model").otherwise("")
    return F.struct(F.coalesce(converter, F.lit("")).alias("converter"), code.alias("code"))


def note_relative(note: Column, src: Column) -> Column:
    """src against the note's folder, with . and .. taken out; null where it leaves the vault."""
    folder = F.when(F.contains(note, F.lit("/")), F.regexp_replace(note, r"/[^/]*$", "/")).otherwise("")
    parts = F.split(F.when(F.startswith(src, F.lit("/")), F.substring(src, F.lit(2), F.char_length(src))).otherwise(F.concat(folder, src)), "/")
    empty = F.slice(parts, 1, 0)
    start = F.struct(empty.alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        return F.struct(
            F.when(s.isin("", "."), acc["p"]).when(up & (F.size(acc["p"]) > 0), F.slice(acc["p"], F.lit(1), F.size(acc["p"]) - 1)).when(up, acc["p"]).otherwise(F.concat(acc["p"], F.array(s))).alias("p"),
            (acc["ok"] & ~(up & (F.size(acc["p"]) == 0))).alias("ok"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["p"], "/")))
