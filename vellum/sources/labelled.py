"""Labelled query sets for evaluation, run-event lines, stored vectors and conversion of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, type string, data string, code int, dur_ms long"
KINDS = ("output", "display", "error", "done")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, query, kind, ord, relevant (map of path and grade) from a JSON array, in file order."""
    rows = spark.read.schema("id string, query string, kind string, relevant map<string,int>").json(path, multiLine=True)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def grades(queries: DataFrame) -> DataFrame:
    """qid, note, grade: a row per labelled note."""
    return queries.select(F.col("id").alias("qid"), F.explode("relevant").alias("note", "grade"))


def faults(queries: DataFrame) -> DataFrame:
    """id, fault of a query set that can't be used: empty, repeated id, no text, grade beyond 1 to 3."""
    repeated = queries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("fault"))
    blank = queries.where(F.coalesce(F.trim("query"), F.lit("")) == "").select("id", F.lit("no text").alias("fault"))
    odd = queries.where(F.exists(F.map_values("relevant"), lambda g: ~g.between(1, 3))).select("id", F.lit("grade beyond 1 to 3").alias("fault"))
    none = queries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no queries").alias("fault"))
    return repeated.unionByName(blank).unionByName(odd).unionByName(none)


def run_events(lines: DataFrame, line: str = "value", stream: str | None = None, order: str | None = None) -> DataFrame:
    """lines with event (null where it can't be read) and ok; blank lines are left out.

    A line that isn't JSON or has an unknown type isn't ok; with stream and order columns, what follows
    it in its stream is left out.
    """
    event = F.from_json(line, EVENT)
    rows = lines.where(F.trim(line) != "").withColumn("event", event)
    rows = rows.withColumn("ok", F.coalesce(F.col("event.type").isin(*KINDS), F.lit(False)))
    if stream is None or order is None:
        return rows
    first = rows.where(~F.col("ok")).groupBy(stream).agg(F.min(order).alias("_bad"))
    return rows.join(first, stream, "left").where(F.col("_bad").isNull() | (F.col(order) <= F.col("_bad"))).drop("_bad")


def stored_vectors(rows: DataFrame, blob: str = "embedding", dim: int | None = None) -> DataFrame:
    """rows with their little-endian float32 blobs as arrays; null where the length is wrong."""

    @F.pandas_udf("array<float>")
    def read(raw: pd.Series) -> pd.Series:
        fits = lambda b: b is not None and len(b) % 4 == 0 and (dim is None or len(b) == 4 * dim)
        return raw.map(lambda b: np.frombuffer(b, "<f4") if fits(b) else None)

    return rows.withColumn(blob, read(blob))


def fit_pixels(width: Column, height: Column, most: Column) -> Column:
    """struct(width, height) scaled down evenly to at most so many pixels, one at least each way."""
    scale = F.sqrt(F.least(F.lit(1.0), most / (width * height)))
    return F.struct(*[F.greatest(F.lit(1), F.floor(side * scale)).cast("int").alias(n) for n, side in (("width", width), ("height", height))])


def page_prompts(pages: DataFrame) -> DataFrame:
    """pages (doc, page, raw) with the text before them (previous) for a model that structures them."""
    from pyspark.sql import Window

    return pages.withColumn("previous", F.coalesce(F.lag("raw").over(Window.partitionBy("doc").orderBy("page")), F.lit("")))


def structure_pages(pages: DataFrame, structure: Callable[[str, str, list[str]], str]) -> DataFrame:
    """doc, markdown from pages (doc, page, raw): each page in turn, told of the one before and all headings.

    structure(raw, previous, headings) is the injected model. Where it fails or gives nothing, the
    page's raw text stands. A document's pages are read in order from a sorted partition, one at a
    time; only the previous page and the headings are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, previous, headings = None, "", []
        for batch in batches:
            rows = []
            for d, page, raw in zip(batch["doc"], batch["page"], batch["raw"]):
                if d != doc:
                    doc, previous, headings = d, "", []
                try:
                    made = structure(raw or "", previous, headings).strip() or (raw or "")
                except Exception:  # noqa: BLE001 - any failure of the model falls back to this page's raw text
                    made = raw or ""
                previous = made
                headings += [x for x in made.split("\n") if x.startswith("#")]
                rows.append((d, page, made))
            yield pd.DataFrame(rows, columns=["doc", "page", "markdown"])

    ordered = pages.select("doc", "page", "raw").repartition("doc").sortWithinPartitions("doc", "page")
    made = ordered.mapInPandas(run, "doc string, page int, markdown string")
    return made.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda r: r["markdown"]), "\n").alias("markdown"))
