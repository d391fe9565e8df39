"""Free names: the first candidate of each request that neither exists nor was given before.

A request's candidates are its own name, then the name with a suffix before its extension, counting
up. Names whose candidates can meet differ in such suffixes only, so what is left without them is
the key of a group: requests of one group are served in order by one task, which streams over them
and holds the group's taken names. Names in different folders never meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """A suffix: a pattern of all its forms, the first form, and the form with a number from `start` on."""

    pattern: str
    first: str
    more: str
    start: int = 2

    def suffix(self, n: int) -> str:
        """The n-th candidate's suffix; n counts from 1."""
        return self.first if n == 1 else self.more.format(self.start + n - 2)


IMAGE = Style(r"-\d+", "-2", "-{}", 3)
IMPORT = Style(r" \(\d+\)", " (1)", " ({})", 2)
RESTORED = Style(r" \(restored(?: \d+)?\)", " (restored)", " (restored {})")
UNTITLED = Style(r" \d+", " 1", " {}", 2)
_EXT = re.compile(r"\.[^./]*$")


def key_of(path: Column, style: Style) -> Column:
    """The path without suffixes of the style: equal for all names whose candidates can meet."""
    return F.regexp_replace(path, rf"(?:{style.pattern})+(\.[^./]*)?$", "$1")


def allot(requests: DataFrame, existing: DataFrame, style: Style, scope: list[str] = ()) -> DataFrame:
    """scope, ord, path, target of requests (scope, ord, path), served by ord beside existing (scope, path)."""
    keys = [F.concat_ws("\\0", *[F.col(c).cast("string") for c in scope]).alias("_scope")]
    asked = requests.select(*keys, key_of(F.col("path"), style).alias("_key"), F.lit(1).alias("_kind"), F.col("ord").cast("long").alias("ord"), "path", *scope)
    there = existing.select(*keys, key_of(F.col("path"), style).alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("ord"), "path", *scope)
    there = there.join(asked.select("_scope", "_key").distinct(), ["_scope", "_key"], "left_semi").select(asked.columns)
    order = ["_scope", "_key", "_kind", "ord", "path"]
    rows = asked.unionByName(there).repartition("_scope", "_key").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, tried = None, set(), {}
        for batch in batches:
            kept, targets = [], []
            for i, (scope_, key, kind, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                if group != (scope_, key):
                    group, taken, tried = (scope_, key), set(), {}
                name = path
                if kind:
                    ext = _EXT.search(path)
                    cut = ext.start() if ext else len(path)
                    n = tried.get(path, 0)
                    while name in taken:
                        n += 1
                        name = path[:cut] + style.suffix(n) + path[cut:]
                    tried[path] = n
                    kept.append(i)
                    targets.append(name)
                taken.add(name)
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[3:], pa.array(targets, pa.string())], names=[*batch.schema.names[3:], "target"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ["ord", "path", *scope]), "target string"])
    return rows.mapInArrow(run, schema).select(*scope, "ord", "path", "target")


def image_names(references: DataFrame, scope: list[str] = ()) -> DataFrame:
    """scope, image, name of each referenced image (scope, ord, image, name), in order of first reference; one image has one name."""
    first = references.groupBy(*scope, "image").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("path"))
    none = first.where("false").select(*scope, "path")
    return allot(first, none, IMAGE, scope).join(first.select(*scope, "ord", "image"), [*scope, "ord"]).select(*scope, "image", F.col("target").alias("name"))


def import_names(imports: DataFrame, existing: DataFrame) -> DataFrame:
    """ord, name, target of imports (ord, name) beside existing (name); a .markdown import becomes .md."""
    asked = imports.select("ord", "name", F.regexp_replace("name", r"(?i)\.markdown$", ".md").alias("path"))
    given = allot(asked, existing.select(F.col("name").alias("path")), IMPORT)
    return asked.select("ord", "name").join(given.select("ord", "target"), "ord")


def restore_names(trashed: DataFrame, notes: DataFrame) -> DataFrame:
    """ord, path, target: where each trashed file (ord, path) goes back to beside the notes (path); none is overwritten."""
    return allot(trashed, notes, RESTORED)


def untitled_names(folders: DataFrame, existing: DataFrame, ext: str = ".md") -> DataFrame:
    """ord, target of new notes in folders (ord, folder; empty: the root) beside existing (path)."""
    asked = folders.select("ord", F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit(f"Untitled{ext}")).alias("path"))
    return allot(asked, existing, UNTITLED).select("ord", "target")
