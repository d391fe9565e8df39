"""Word-processor heuristics as expressions: list markers, headings, runs of positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bullet glyphs; twips of an indent level; most bytes of a bold line that is a heading.
BULLETS = "•◦▪‣·–*-"
INDENT, HEADING_BYTES = 360, 50


def list_marker(text: Column) -> Column:
    """struct(kind, rest): bullet, number, letter or none, and the text after the marker."""
    t = F.ltrim(text)
    bullet, number, letter = rf"^[{BULLETS[:-2]}*\-][ \t]+", r"^\d{1,3}[.)][ \t]+", r"^[a-z][.)][ \t]+"
    kind = F.when(t.rlike(bullet), "bullet").when(t.rlike(number), "number").when(t.rlike(letter), "letter").otherwise("none")
    rest = F.when(kind == "bullet", F.regexp_replace(t, bullet, "")).when(kind == "number", F.regexp_replace(t, number, "")).when(kind == "letter", F.regexp_replace(t, letter, "")).otherwise(text)
    return F.struct(kind.alias("kind"), F.trim(rest).alias("rest"))


def looks_like_heading(text: Column) -> Column:
    """A short line without colon or final period."""
    t = F.trim(text)
    return (t != "") & (F.octet_length(t) <= HEADING_BYTES) & ~F.contains(t, F.lit(":")) & ~F.endswith(t, F.lit("."))


def indent_level(twips: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(twips / INDENT)).cast("int")


def join_runs(runs: DataFrame) -> DataFrame:
    """doc, page, text from positioned runs (doc, page, ord, s, x, y, w, font_size).

    A new line where y moves by more than the mean font size, a blank where the gap is a fifth of it.
    """
    w = Window.partitionBy("doc", "page").orderBy("ord")
    before = {c: F.lag(c).over(w) for c in ("x", "y", "w", "font_size")}
    mean = (F.col("font_size") + before["font_size"]) / 2
    glue = F.when(before["y"].isNull(), "").when(F.abs(F.col("y") - before["y"]) > mean, "\n").when(F.col("x") - (before["x"] + before["w"]) >= F.col("font_size") / 5, " ").otherwise("")
    pieces = runs.select("doc", "page", "ord", F.concat(glue, F.regexp_replace("s", r"[^\P{C}\n\t]", "")).alias("s"))
    page = pieces.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda r: r["s"]), "").alias("t"))
    return page.select("doc", "page", F.array_join(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), "\n").alias("text"))
