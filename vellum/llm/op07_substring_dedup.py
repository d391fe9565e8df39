"""Removal of repeated lines and passages: units are hashed, and only the earliest occurrence stays.

Units are lines, sentences (also those that go on over line breaks of a paragraph) and the shortest
runs of neighbouring short lines and sentences that reach the size, in lower case with single
spaces. Sizes are words, or half the characters where a script has no blanks; a sentence of over 50
words is cut at places its words choose. Units get a 128-bit digest; Spark groups the digests of all documents, keeps for each its occurrence of
lowest rank (doc_id, then place) and takes the others out of the texts. A line that repeats goes as
a whole, with its short sentences; a passage that stands inside other lines goes sentence by
sentence (the parts of sentences at its two ends stay). What goes is reported with its original offsets.

Digests are counted with map-side combination and hot ones are resolved where they stand, so a line
that a third of all documents share is one row per task in any shuffle. Defined cases: null and empty texts have no units; of rows equal
in doc_id and text all are treated as one document; a null doc_id ranks after all others; an empty
table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, small_batches, table

#: Least size of a line, and of a sentence or run of pieces, that can be removed.
LINE_WORDS, SENTENCE_WORDS = 8, 8
#: Sentences above this size are cut after chosen words, one in CUT; without blanks after one character in 2 * CUT.
LONG, CUT = 50, 16
#: A digest of one unit in so many, or more, is hot; no more digests than that can be.
HOT = 1000
_SENTENCE = re.compile(r"[^.!?。！？．｡]+[.!?。！？．｡]*\s*|[.!?。！？．｡]+\s*")
#: Scripts without blanks between words; two characters count as a word.
_SOLID = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(r"\S+")

Piece = tuple[int, int, int, str]


def size_of(text: str, words: int) -> int:
    return words if text.isascii() else max(words, len(_SOLID.findall(text)) // 2)


def pieces(text: str, at: int) -> Iterator[Piece]:
    """(start, end, size, normal form) of the sentences of text, which stands at that offset; long ones in parts."""
    for m in _SENTENCE.finditer(text):
        span, start = m.group(), at + m.start()
        words = span.split()
        if not words:
            continue
        feed = span.find("\n", len(span.rstrip()))
        end = start + (len(span) if feed < 0 else feed)
        size = size_of(span, len(words))
        if size <= LONG:
            yield start, end, size, " ".join(words).lower()
            continue
        # The cuts depend on the words beside them only, so equal passages are cut alike.
        if len(words) > LONG // 2:
            found = [(w.end(), w.group().lower()) for w in _WORD.finditer(span)]
            cuts = [e for (e, w), (_, v) in zip(found, found[1:]) if zlib.crc32(f"{w} {v}".encode("utf-8", "replace")) % CUT == 0]
        else:
            low = span.lower() if len(span.lower()) == len(span) else span
            cuts = [i for i in range(4, len(span.rstrip())) if zlib.crc32(low[i - 4 : i].encode("utf-8", "replace")) % (2 * CUT) == 0]
        for lo, hi in zip([0, *cuts], [*cuts, end - start]):
            inner = span[lo:hi].split()
            if inner:
                yield start + lo, start + hi, size_of(span[lo:hi], len(inner)), " ".join(inner).lower()


def runs(some: list[Piece], least: int) -> Iterator[tuple[int, int, str]]:
    """The shortest runs of neighbouring pieces of that size, one from and one up to each piece.

    So every piece of a repeated passage of that size stands in a run that lies inside the passage.
    """
    found, lo, total = set(), 0, 0
    for hi, piece in enumerate(some):
        total += piece[2]
        while total >= least:
            found.add((lo, hi))  # the shortest from lo
            total -= some[lo][2]
            lo += 1
        if lo:
            # The shortest up to hi starts at lo - 1, where that reaches the size.
            if total + some[lo - 1][2] >= least:
                found.add((lo - 1, hi))
    for i, j in sorted(found):
        yield some[i][0], some[j][1], some[i][3] if i == j else " ".join(p[3] for p in some[i : j + 1])


def units(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normal form) of the lines, and of runs of sentences in lines and in paragraphs."""
    start, every, seen, paragraph, spread = 0, [], set(), None, []
    for line in [*text.split("\n"), ""]:
        words = line.split()
        if words:
            inside = list(pieces(line, start))
            every += inside
            if len(inside) > 1 and size_of(line, len(words)) >= line_words:
                seen.add((start, start + len(line)))
                yield start, start + len(line), " ".join(words).lower()
            paragraph = (start if paragraph is None else paragraph[0], start + len(line), 1 if paragraph is None else paragraph[2] + 1)
        elif paragraph:
            if paragraph[2] > 1:
                spread.append(paragraph)
            paragraph = None
        start += len(line) + 1
    for unit in runs(every, sentence_words):
        if unit[:2] not in seen:
            seen.add(unit[:2])
            yield unit
    own = {p[:2] for p in every}
    for lo, hi, _ in spread:  # sentences that go on over line breaks, so that a passage may be wrapped anew
        whole = list(pieces(text[lo:hi], lo))
        if all(p[:2] in own for p in whole):
            continue
        for unit in runs(whole, sentence_words):
            if unit[:2] not in seen:
                seen.add(unit[:2])
                yield unit


def remove(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the joined spans; a line that goes takes its line break."""

    def joined(some: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for start, end in sorted(some):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((start, end))
        return out

    def with_break(start: int, end: int) -> tuple[int, int]:
        whole = (start == 0 or text[start - 1] == "\n") and end < len(text) and text[end] == "\n"
        return start, end + whole

    # Sentences that go may make up a line together, so lines are looked for after joining.
    merged = joined([with_break(*x) for x in joined(spans)])
    kept, at = [], 0
    for start, end in merged:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return "".join(kept), merged


def digests(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """A row per unit: its digest (two longs), its document (doc_id and text hash) and its span."""
    names = ["a", "b", "doc_id", "h", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, hs, starts, ends = [], [], [], [], []
            for doc_id, text, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for start, end, form in units(text, line_words, sentence_words):
                    hashes.append(xxhash.xxh3_128_digest(form))
                    ids.append(doc_id)
                    hs.append(h)
                    starts.append(start)
                    ends.append(end)
            pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "a long, b long, doc_id long, h long, start int, end int")


def removals(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, h and the spans to remove, for the documents that lose any.

    Half a digest is counted first, so that units that stand once, nearly all, are shuffled in few
    bytes. Digests of one unit in `hot` or more (at most so many of them, so their first places are
    broadcast) never leave their tasks; no other digest has more than one unit in `hot`.
    """
    rows = materialize(digests(docs, line_words, sentence_words), "units")
    counted = materialize(rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    limit = -(-rows.count() // hot)
    often, seldom = counted.where(F.col("n") >= limit).select("a", F.lit(True).alias("hot")), counted.where(F.col("n") < limit).select("a")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "start", "end")
    # Rows equal in doc_id and text are one document, so their ranks are equal.
    later = rank != F.col("first")
    marked, hot_row = rows.join(F.broadcast(often), "a", "left"), F.col("hot").isNotNull()
    firsts = marked.groupBy(F.when(hot_row, F.col("a")).alias("a"), F.when(hot_row, F.col("b")).alias("b")).agg(F.min(F.when(hot_row, rank)).alias("first")).where("first is not null")
    settled = rows.join(F.broadcast(firsts), ["a", "b"], "left").where(F.coalesce(later, F.lit(False)))
    rare = rows.join(F.broadcast(often), "a", "left_anti").join(seldom, "a", "left_semi")
    rare = rare.withColumn("first", F.first(rank).over(Window.partitionBy("a", "b").orderBy(rank))).where(later)
    # Runs of one text may overlap (the same short line again and again); the first occurrence stays whole.
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    later = settled.unionByName(rare).withColumn("start", F.when(own, F.greatest("start", F.col("first.end"))).otherwise(F.col("start"))).where("start < end")
    spans = later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # at most a document's units
    return spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")


def deduplicate(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS, report: bool = False) -> DataFrame:
    """docs with the repeats taken out of text (and n_chars, where there is one, counted anew).

    report: doc_id, text, n_removed and the removed spans instead of docs' columns.
    """
    gone = materialize(removals(docs, line_words, sentence_words), "removals")
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    packed = docs.select(F.struct(*[docs[c] for c in (["text"] if report else docs.columns)]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), h.alias("_hash"))
    joined = packed.join(gone, packed["_doc"].eqNullSafe(gone["_id"]) & (packed["_hash"] == gone["_h"]), "left")
    joined = joined.select("_row", F.coalesce("_row.text", F.lit("")).alias("_text"), "_doc", "spans")
    columns, kept_type = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [remove(t, [(s["start"], s["end"]) for s in spans]) if spans else (t, []) for t, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            texts = [t for t, _ in done]
            if report:
                spans = pa.array([[{"start": a, "end": b} for a, b in x] for _, x in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), pa.array([len(x) for _, x in done], pa.int32()), spans], names=["doc_id", "text", "n_removed", "removed"])
                continue
            out = dict(zip(columns, batch.column(0).flatten()))
            lost = [bool(x) for _, x in done]
            if any(lost):
                old = out["text"].to_pylist()
                out["text"] = pa.array([t if x else o for t, x, o in zip(texts, lost, old)], pa.string())
                if "n_chars" in out:
                    out["n_chars"] = pa.array([len(t) if x else o for t, x, o in zip(texts, lost, out["n_chars"].to_pylist())], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, "doc_id long, text string, n_removed int, removed array<struct<start: int, end: int>>" if report else kept_type)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), report=True)
