"""Links of notes as Markdown links or text that show the titles of the notes they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import links as L
from vellum.functions import markdown as M
from vellum.functions.text import percent_encode, trim_markdown_ext
from vellum.operators.stores import resolve_links


def note_titles(notes: DataFrame) -> DataFrame:
    """path, title of notes (path, body): the first heading, else the file's name."""
    name = trim_markdown_ext(F.element_at(F.split("path", "/"), -1))
    return notes.select("path", F.coalesce(M.first_heading(M.note_body(F.col("body"))), name).alias("title"))


def target_titles(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """target, title of distinct targets that lead to a note."""
    distinct = targets.select("target").where("target <> ''").distinct()
    found = resolve_links(distinct.withColumn("link_id", F.col("target")), notes).where("path is not null").select("target", "path")
    return found.join(note_titles(notes), "path").select("target", "title")


def _whole(part: Column) -> Column:
    """A target percent-encoded as one segment, its slashes too."""
    return F.replace(percent_encode(F.replace(part, F.lit("/"), F.lit("\u0000"))), F.lit("%00"), F.lit("%2F"))


def show_links(bodies: DataFrame, notes: DataFrame, flat: bool = False) -> DataFrame:
    """id, text of bodies (id, body): every link outside code shows its alias, else its target's title and heading.

    flat: as plain text, else as Markdown links to the target as it is written. Links are taken out
    with their places, joined with the titles of their targets, and put back in order; a body that
    has none meets nothing.
    """
    spans = bodies.select("id", F.explode(L.link_spans(F.col("body"))).alias("s")).select("id", "s.*")
    titled = spans.join(target_titles(spans, notes), "target", "left")
    shown = F.coalesce("title", "target")
    label = F.when(F.col("label") != "", F.col("label")).when(F.col("heading") != "", F.concat(shown, F.lit(" › "), F.col("heading"))).otherwise(shown)
    part = F.when(F.col("heading") != "", F.concat(F.lit("#"), _whole(F.col("heading")))).otherwise("")
    text = label if flat else F.concat(F.lit("["), label, F.lit(f"]({L.SCHEME}"), _whole(F.col("target")), part, F.lit(")"))
    parts = titled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", text.alias("text")))).alias("parts"))
    return bodies.select("id", "body").join(parts, "id", "left").select("id", L.splice(F.col("body"), F.col("parts")).alias("text"))
