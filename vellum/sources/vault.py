"""A vault's folder as a data source: its files and folders, its notes as a sink, its changes as a stream.

Paths are URIs or local paths that pyarrow's file systems open. Names are listed as in the vault:
only folders whose name begins with a full stop are left out, unless `hidden` is set; files keep
whatever name they have, and empty folders are rows of their own.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vellum.functions import markdown as M

#: Bytes of file contents in a batch; files a partition reads where their folders were listed by the driver.
BATCH_BYTES, FILES = 8 << 20, 256
FILE = "path string, is_dir boolean, size long, modified timestamp, created timestamp, content binary"
CHANGE = "path string, op string, is_dir boolean, ts timestamp"


class Folder:
    """A folder on some file system; names are relative to it, with slashes."""

    def __init__(self, root: str):
        from pyarrow import fs

        root = re.sub(r"^file:/+", "/", root)
        self.fs, self.base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        self.base = self.base.rstrip("/")
        self.kinds, self.selector = fs.FileType, fs.FileSelector
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def full(self, rel: str) -> str:
        return f"{self.base}/{rel}" if rel else self.base

    def children(self, rel: str, hidden: bool) -> list[tuple[str, pa.fs.FileInfo]]:
        """(name, info) of what a folder holds, by name; folders that were removed meanwhile hold nothing."""
        found = sorted(self.fs.get_file_info(self.selector(self.full(rel), allow_not_found=True)), key=lambda i: i.base_name)
        named = [(f"{rel}/{i.base_name}" if rel else i.base_name, i) for i in found]
        return [(n, i) for n, i in named if hidden or not (i.is_file is False and i.base_name.startswith("."))]

    def walk(self, rel: str, hidden: bool) -> Iterator[tuple[str, pa.fs.FileInfo]]:
        for name, info in self.children(rel, hidden):
            yield name, info
            if info.type == self.kinds.Directory:
                yield from self.walk(name, hidden)

    def born(self, rel: str) -> float | None:
        """The time of birth, where the file system tells it."""
        return getattr(os.stat(self.full(rel)), "st_birthtime", None) if self.local else None

    def read(self, rel: str) -> bytes:
        with self.fs.open_input_stream(self.full(rel)) as f:
            return f.read()

    def write(self, rel: str, content: bytes) -> None:
        """Whole or not at all: under another name first, then moved."""
        folder, _, name = self.full(rel).rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(content)
        self.fs.move(draft, f"{folder}/{name}")

    def there(self, rel: str) -> bool:
        return self.fs.get_file_info(self.full(rel)).type != self.kinds.NotFound


@dataclass
class Part(InputPartition):
    """Names to read as they are, and folders to walk."""

    names: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)


class VaultReader(DataSourceReader):
    """The driver lists folders level by level only until there are enough to share out; tasks list the rest."""

    def __init__(self, options: dict):
        self.root, self.hidden = options["path"], options.get("hidden", "false").lower() == "true"
        self.content, self.least = options.get("content", "true").lower() == "true", int(options.get("partitions", 64))

    def partitions(self) -> list[Part]:
        folder, names, open_ = Folder(self.root), [], [""]
        while open_ and len(open_) < self.least:
            at = open_.pop(0)
            for name, info in folder.children(at, self.hidden):
                names.append(name)
                if info.type == folder.kinds.Directory:
                    open_.append(name)
        return [Part(names=names[i : i + FILES]) for i in range(0, len(names), FILES)] + [Part(folders=[f]) for f in open_] or [Part()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.root)
        rows, size = [], 0

        def found() -> Iterator[tuple[str, pa.fs.FileInfo]]:
            for name in part.names:
                yield name, folder.fs.get_file_info(folder.full(name))
            for at in part.folders:
                yield from folder.walk(at, self.hidden)

        for name, info in found():
            if info.type == folder.kinds.NotFound:
                continue
            is_dir = info.type == folder.kinds.Directory
            body = folder.read(name) if self.content and not is_dir else None
            born = folder.born(name)
            modified = info.mtime_ns // 1000
            rows.append((name, is_dir, None if is_dir else info.size, modified, modified if born is None else int(born * 1e6), body))
            size += len(body or b"")
            if size >= BATCH_BYTES or len(rows) >= 4096:
                yield as_batch(rows)
                rows, size = [], 0
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    time_ = pa.timestamp("us", tz="UTC")
    kinds = (pa.string(), pa.bool_(), pa.int64(), time_, time_, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[c.split()[0] for c in FILE.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: how many files it wrote, removed and left, and the names of the new ones."""

    written: int
    removed: int
    refused: int
    fresh: list[str]


class VaultWriter(DataSourceWriter):
    """Rows (path, body) become files; a null body removes its file. A task that is run again does the same again.

    conflict: overwrite, or refuse to leave files that are there. report: a file for the counts, in JSON.
    """

    def __init__(self, options: dict, schema: StructType):
        self.root, self.refuse, self.report = options["path"], options.get("conflict", "overwrite") == "refuse", options.get("report")
        self.path, self.body = schema.fieldNames().index("path"), schema.fieldNames().index("body")

    def write(self, rows: Iterator) -> Written:
        folder, told = Folder(self.root), Written(0, 0, 0, [])
        for row in rows:
            path, body = row[self.path], row[self.body]
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path inside the vault: {path!r}")
            there = folder.there(path)
            if body is None:
                if there:
                    folder.fs.delete_file(folder.full(path))
                told.removed += there
            elif there and self.refuse:
                told.refused += 1
            else:
                folder.write(path, body.encode() if isinstance(body, str) else bytes(body))
                told.written += 1
                if not there:
                    told.fresh.append(path)
        return told

    def commit(self, messages: list[Written | None]) -> None:
        if self.report:
            done = [m for m in messages if m is not None]
            where, _, name = self.report.rpartition("/")
            Folder(where).write(name, json.dumps({k: sum(getattr(m, k) for m in done) for k in ("written", "removed", "refused")}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that were new go again; those that were overwritten keep their new text."""
        folder = Folder(self.root)
        for m in messages:
            for path in m.fresh if m is not None else ():
                if folder.there(path):
                    folder.fs.delete_file(folder.full(path))


@dataclass
class Between(InputPartition):
    start: int
    end: int
    k: int
    of: int


class VaultChanges(DataSourceStreamReader):
    """Offsets are numbers of listings that stand in the `state` folder; rows are what differs between two.

    A rename is a removal and a creation, of the folder and of all it holds. Tasks share the names
    out by hash. Listing 0 is empty, so a new stream begins with everything there is.
    """

    def __init__(self, options: dict):
        self.root, self.state, self.hidden = options["path"], options["state"], options.get("hidden", "false").lower() == "true"
        self.parts = int(options.get("partitions", 4))

    def _load(self, n: int) -> tuple[dict[str, tuple], int]:
        import pyarrow.parquet as pq

        if n == 0:
            return {}, 0
        folder = Folder(self.state)
        with folder.fs.open_input_file(folder.full(f"{n}.parquet")) as f:
            t = pq.read_table(f)
        return {p: tuple(r) for p, *r in zip(*(c.to_pylist() for c in t.columns))}, int(t.schema.metadata[b"ts"])

    def _known(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n, _ in Folder(self.state).children("", True) if n.endswith(".parquet") and n.split(".")[0].isdigit())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        import pyarrow.parquet as pq

        folder = Folder(self.root)
        now = {n: (i.type == folder.kinds.Directory, None if i.type == folder.kinds.Directory else i.size, None if i.type == folder.kinds.Directory else i.mtime_ns // 1000) for n, i in folder.walk("", self.hidden)}
        last = max(self._known(), default=0)
        if now == self._load(last)[0]:
            return {"listing": last}
        table = pa.table({"path": pa.array(list(now), pa.string()), "is_dir": pa.array([v[0] for v in now.values()], pa.bool_()), "size": pa.array([v[1] for v in now.values()], pa.int64()), "modified": pa.array([v[2] for v in now.values()], pa.int64())})
        out = pa.BufferOutputStream()
        pq.write_table(table.replace_schema_metadata({"ts": str(int(time.time() * 1e6))}), out)
        Folder(self.state).write(f"{last + 1}.parquet", out.getvalue().to_pybytes())
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(start["listing"], end["listing"], k, self.parts) for k in range(self.parts)]

    def read(self, part: Between) -> Iterator[pa.RecordBatch]:
        (old, _), (new, ts) = self._load(part.start), self._load(part.end)
        rows = []
        for name in old.keys() | new.keys():
            if zlib.crc32(name.encode()) % part.of == part.k:
                before, after = old.get(name), new.get(name)
                if before and (after is None or after[0] != before[0]):
                    rows.append((name, "remove", before[0], ts))
                if after and (before is None or after[0] != before[0]):
                    rows.append((name, "create", after[0], ts))
                elif after and after != before:
                    rows.append((name, "write", after[0], ts))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.bool_(), pa.timestamp("us", tz="UTC")))], names=[c.split()[0] for c in CHANGE.split(", ")])

    def commit(self, end: dict) -> None:
        """Listings before the end of a finished batch aren't needed again."""
        folder = Folder(self.state)
        for n in self._known():
            if n < end["listing"]:
                folder.fs.delete_file(folder.full(f"{n}.parquet"))


class VaultSource(DataSource):
    """vault: read (path, hidden, content, partitions) and write (path, conflict, report)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return FILE

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options, schema)


class VaultChangeSource(DataSource):
    """vault_changes: a stream (path, state, hidden, partitions)."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> VaultChanges:
        return VaultChanges(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
    spark.dataSource.register(VaultChangeSource)


def read_files(spark: SparkSession, root: str, hidden: bool = False, content: bool = True) -> DataFrame:
    """FILE of all files and folders under root."""
    register(spark)
    return spark.read.format("vault").options(path=root, hidden=str(hidden), content=str(content)).load()


def walk_key(path: str = "path") -> Column:
    """Orders paths as a walk meets them, folder by folder."""
    return F.split(path, "/")


def read_notes(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path, body, doc_hash, modified, created of the notes under root; hidden: also those in hidden folders, as the trash."""
    rows = read_files(spark, root, hidden).where(~F.col("is_dir") & M.is_markdown(F.col("path")))
    return rows.select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("doc_hash"), "modified", "created")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, parent, name, is_dir, is_note, tags, aliases of all folders (empty ones, too) and files; notes lose their extension in name."""
    rows = read_files(spark, root)
    note = ~F.col("is_dir") & M.is_markdown(F.col("path"))
    base = F.element_at(F.split("path", "/"), -1)
    props = F.when(note, M.properties(M.frontmatter_block(F.decode("content", "UTF-8"))))
    rows = rows.select("path", F.regexp_replace(F.col("path"), r"/?[^/]*$", "").alias("parent"), F.when(note, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base).alias("name"), "is_dir", note.alias("is_note"), props.alias("props"))
    values = lambda *keys: F.coalesce(M.property_values(F.col("props"), *keys), F.array().cast("array<string>"))
    return rows.select("path", "parent", "name", "is_dir", "is_note", values("tags", "tag").alias("tags"), values("aliases", "alias").alias("aliases"))


def write_notes(notes: DataFrame, root: str, conflict: str = "overwrite", report: str | None = None) -> None:
    """notes (path, body; a null body removes the note) as files under root."""
    register(notes.sparkSession)
    more = {"report": report} if report else {}
    notes.select("path", "body").write.format("vault").mode("append").options(path=root, conflict=conflict, **more).save()


def changes(spark: SparkSession, root: str, state: str, hidden: bool = False) -> DataFrame:
    """A stream of CHANGE rows; state: a folder of its own for the listings."""
    register(spark)
    return spark.readStream.format("vault_changes").options(path=root, state=state, hidden=str(hidden)).load()
