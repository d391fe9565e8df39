"""Line deduplication that returns compressed keep bitmaps in place of texts.

Every long line gets a 128-bit digest. Digests are range-partitioned with their documents (largest
id first) and positions as secondary sort keys, so that one digest may run over several tasks. A
task streams over its sorted rows: the first document of a run keeps its lines, the others lose
theirs as soon as the run is known to hold enough documents. A run at the edge of a task may go on
in the next one; its rows stay pending, and a few rows that sum it up are merged for all tasks.
Dropped positions become one bitmap a document.

Defined cases: null and empty texts are one empty line; rows that share an id are one document for
counting, each with a bitmap of its own; a null id counts as the smallest of all ids; equal rows
get equal bitmaps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import materialize, small_batches, table

#: Code points of a key that counts, and documents that a key must be in to lose lines.
LEAST_CHARS, LEAST_DOCS = 40, 5
NO_ID = -(2**63)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, id (no nulls), t (digest of the text: tells rows of one id apart), text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))


def long_keys(text: bytes, least: int) -> tuple[int, list[int], list[bytes]]:
    """Number of lines; positions and keys of those whose key has enough code points.

    Bytes are stripped of, and lower-cased in, ASCII only; both leave other code points alone.
    """
    lines = text.lower().split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        key = line.strip()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            at.append(i)
            keys.append(key)
    return len(lines), at, keys


def line_digests(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """hi, lo, id, t, pos of every long line; and a row with null digest per document, pos its number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            counts, found, at, digests = [], [], [], []
            for text in batch.column(2).to_pylist():
                n, places, keys = long_keys(text, least_chars)
                counts.append(n)
                found.append(len(places))
                at += places
                digests += map(xxhash.xxh3_128_digest, keys)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            head = pa.nulls(len(ids), pa.int64())
            of = np.repeat(np.arange(len(ids)), found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([head, pa.array(halves[:, 0])]), pa.concat_arrays([head, pa.array(halves[:, 1])]),
                    pa.array(np.concatenate([ids, ids[of]])), pa.array(np.concatenate([ts, ts[of]])), pa.array(np.asarray(counts + at, dtype=np.int32)),
                ],
                names=["hi", "lo", "id", "t", "pos"],
            )

    small_batches(docs.sparkSession)
    return rows_of(docs).select("id", "t", "text").mapInArrow(run, "hi long, lo long, id long, t long, pos int")


class Runs:
    """Streams sorted (hi, lo, id descending) rows of a task and tells the lines that go.

    Settled rows have null digests. Rows of the task's first run, and of its last one if few
    documents of it were seen, are pending under their digest; both runs' largest ids follow as
    edge rows. Rows are held back for fewer than least_docs documents of one run.
    """

    def __init__(self, least_docs: int):
        self.least, self.key, self.first, self.largest, self.held = least_docs, None, True, [], []
        self.out: list[tuple] = []

    def emit(self, ids, ts, pos, key=None, edge=False) -> None:
        if len(ids):
            self.out.append((key, edge, ids, ts, pos))

    def feed(self, ids: np.ndarray, ts: np.ndarray, pos: np.ndarray) -> None:
        """More rows of the open run."""
        for x in ids[np.concatenate([[True], ids[1:] != ids[:-1]])]:
            if len(self.largest) == self.least:
                break
            if not self.largest or self.largest[-1] != x:
                self.largest.append(int(x))
        if self.first:
            self.emit(ids, ts, pos, self.key)
            return
        self.held.append((ids, ts, pos))
        if len(self.largest) == self.least:
            for i, t, p in self.held:
                go = i != self.largest[0]
                self.emit(i[go], t[go], p[go])
            self.held = []

    def edge(self) -> None:
        n = len(self.largest)
        self.emit(np.asarray(self.largest, dtype=np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), self.key, True)

    def turn(self, key) -> None:
        """The open run has ended inside the task; another begins."""
        if self.key is not None:
            if self.first:
                self.edge()
            self.first = False
        self.key, self.largest, self.held = key, [], []

    def end(self) -> None:
        if self.key is not None:
            for rows in self.held:
                self.emit(*rows, self.key)
            self.edge()

    def batch(self, hi, lo, ids, ts, pos) -> None:
        new = np.concatenate([[self.key != (hi[0], lo[0])], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        starts = np.flatnonzero(new)
        if not len(starts) or starts[0]:
            n = starts[0] if len(starts) else len(hi)
            self.feed(ids[:n], ts[:n], pos[:n])
        if not len(starts):
            return
        open_first = self.key is None  # the run that opens the task isn't settled here
        whole = starts[1:] if open_first else starts
        if open_first:
            self.turn((hi[0], lo[0]))
            n = whole[0] if len(whole) else len(hi)
            self.feed(ids[:n], ts[:n], pos[:n])
        if not len(whole):
            return
        if len(whole) > 1:  # runs that begin and end in this batch
            lo_, end = whole[0], whole[-1]
            mine, own = ids[lo_:end], whole[:-1] - lo_
            fresh = new[lo_:end].copy()
            fresh[1:] |= mine[1:] != mine[:-1]
            size = np.diff(np.append(own, len(mine)))
            many = np.repeat(np.add.reduceat(fresh.astype(np.int64), own) >= self.least, size)
            go = many & (mine != np.repeat(mine[own], size))
            self.emit(mine[go], ts[lo_:end][go], pos[lo_:end][go])
        last = whole[-1]
        self.turn((hi[last], lo[last]))
        self.feed(ids[last:], ts[last:], pos[last:])

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        fill = lambda i: np.repeat([r[0][i] if r[0] is not None else 0 for r in rows] or [0], [len(r[2]) for r in rows] or [0]).astype(np.int64)
        none = np.repeat([r[0] is None for r in rows] or [False], [len(r[2]) for r in rows] or [0])
        each = lambda i, t: np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(fill(0), mask=none), pa.array(fill(1), mask=none), pa.array(np.repeat([r[1] for r in rows] or [False], [len(r[2]) for r in rows] or [0])), pa.array(each(2, np.int64)), pa.array(each(3, np.int64)), pa.array(each(4, np.int32))],
            names=["hi", "lo", "edge", "id", "t", "pos"],
        )


def dropped_lines(digests: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, t, pos of the lines that go; digests: hi, lo, id, t, pos of long lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(least_docs)
        for batch in batches:
            if batch.num_rows:
                runs.batch(*(c.to_numpy() for c in batch.columns))
                yield runs.take()
        runs.end()
        yield runs.take()

    order = ["hi", "lo", F.desc("id"), "pos", "t"]
    spread = digests.repartitionByRange(*order).sortWithinPartitions(*order)
    told = materialize(spread.mapInArrow(run, "hi long, lo long, edge boolean, id long, t long, pos int"), "line-runs")
    # Two runs a task at most, each in least_docs rows: the joined side grows with the number of tasks alone.
    edges = told.where("edge").groupBy("hi", "lo").agg(F.count_distinct("id").alias("n"), F.max("id").alias("top")).where(F.col("n") >= least_docs)
    pending = told.where("not edge and hi is not null").join(F.broadcast(edges), ["hi", "lo"]).where("id <> top")
    return told.where("hi is null").select("id", "t", "pos").unionByName(pending.select("id", "t", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, t, n_lines, n_dropped, keep: a row per id and text; keep is a deflated bitmap of its lines (1: stays)."""
    lines = materialize(line_digests(docs, least_chars), "lines")
    heads = lines.where("hi is null").select("id", "t", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    gone = dropped_lines(lines.where("hi is not null"), least_docs).select("id", "t", F.lit(None).cast("int").alias("n_lines"), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, pos in zip(batch.column(2).to_pylist(), batch.column(3)):
                bits = np.ones(n, np.uint8)
                bits[pos.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(p.values) for p in batch.column(3)], pa.int64()), pa.array(maps, pa.binary())], names=["id", "t", "n_lines", "n_dropped", "keep"])

    each = heads.unionByName(gone).groupBy("id", "t").agg(F.max("n_lines").cast("long").alias("n_lines"), F.collect_set("pos").alias("pos"))
    return each.mapInArrow(run, "id long, t long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: documents with the kept lines only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, gone, keep, text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if gone:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    lines = text.split(b"\n")
                    text = b"\n".join([lines[i] for i in np.flatnonzero(bits)])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "text"])

    small_batches(docs.sparkSession)
    both = rows_of(docs).join(bitmaps.hint("shuffle_hash"), ["id", "t"]).select("doc_id", "n_lines", "n_dropped", "keep", "text")
    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text binary").withColumn("text", F.col("text").cast("string"))


def deduplicate_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
hot AS (SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT a.doc_id, a.i, a.l, h.key IS NOT NULL AND a.doc_id <> h.top AS gone FROM lines a LEFT JOIN hot h ON a.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
