"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Documents become byte-level BPE ids, then one end id; longer ones are cut into pieces of at most
the capacity, full pieces last. Pieces of one length are interchangeable, so the instance is fully
described by a histogram of at most `capacity` counts. The dominance reduction and best fit run on
that histogram (its size doesn't depend on the corpus) and give bin patterns with multiplicities;
Spark ranks the pieces of each length and deals them to the places of the patterns.

Defined cases: null and empty texts are one end id; equal rows are packed once each; an empty
table gives an empty result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import byte_letters, materialize, small_batches, table, texts

CAPACITY, END_ID = 2048, 0
#: Texts with an unbroken run this long go to the tokenizers library, whose merging stays n log n.
LONG_RUN = 5_000


class ByteEncoder:
    """Ids of whole texts for a byte-level BPE file of the tokenizers library.

    The file's vocabulary and merge order, read as ranks, go to tiktoken, which gives the same ids
    several times faster; texts with very long unbroken runs go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.long_run = regex.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and self.long_run.search(text):
            ids = np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            ids = self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return ids.tobytes()


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, each with its rank among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, PIECES)


def dominated_pairs(counts: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Martello-Toth reduction: take out of counts (by length) the bins that dominate all others with their largest piece.

    For a length s with room r = capacity - s: alone, if nothing else fits; with k, the largest
    length that fits, if k fills the room, if no two others fit, or if no three fit and every two
    that fit sum to k at most. Each such bin is in some optimal packing.
    """
    fixed = []

    def least(n: int) -> int:
        """Sum of the n smallest pieces; over the capacity if there are fewer."""
        total = 0
        for length, c in enumerate(counts):
            take = min(n, c)
            total, n = total + take * length, n - take
            if not n or total > capacity:
                return total
        return capacity + 1

    def best_two(room: int) -> int:
        lo, hi, best = 1, room, 0
        while lo <= hi:
            if not counts[lo]:
                lo += 1
            elif not counts[hi] or lo + hi > room:
                hi -= 1
            else:
                if lo < hi or counts[lo] > 1:
                    best = max(best, lo + hi)
                lo += 1
        return best

    for s in range(capacity, 0, -1):
        while counts[s]:
            room = capacity - s
            counts[s] -= 1
            k = next((x for x in range(room, 0, -1) if counts[x]), 0)
            fits = not k or k == room or least(2) > room or (least(3) > room and best_two(room) <= k)
            counts[s] += 1
            if not fits:
                break
            if not k:
                n, bin_ = counts[s], ((s, 1),)
            elif k == s:
                n, bin_ = counts[s] // 2, ((s, 2),)
            else:
                n, bin_ = min(counts[s], counts[k]), ((s, 1), (k, 1))
            for length, m in bin_:
                counts[length] -= n * m
            fixed.append((bin_, n))
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit of all counted pieces, longest first; equal open bins are handled together."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        n = counts[s]
        while n:
            room = next((r for r in range(s, capacity) if by_room[r]), None)
            if room is None:
                bin_, have, room = (), n, capacity
            else:
                bin_, have = by_room[room].pop()
            each = min(room // s, n)
            bins = min(have, n // each)
            if room < capacity and have > bins:
                by_room[room].append([bin_, have - bins])
            by_room[room - each * s].append([(*bin_, (s, each)), bins])
            n -= bins * each
    return [(tuple(b), n) for of in by_room for b, n in of]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as ((length, copies), ...) with their numbers, for a histogram of lengths."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    return dominated_pairs(left, capacity) + best_fit(left, capacity)


def places(patterns: list, capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies a bin, first sequence, first offset), sorted by rank."""
    rows: dict[int, list] = {}
    given, sequence = [0] * (capacity + 1), 0
    for bin_, n in patterns:
        offset = 0
        for length, copies in bin_:
            rows.setdefault(length, []).append((given[length], copies, sequence, offset))
            given[length] += n * copies
            offset += length * copies
        sequence += n
    return {k: np.asarray(v, dtype=np.int64) for k, v in rows.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    cut_up = materialize(pieces(docs, path, capacity), "pieces")
    here = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = here.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most `capacity` counts, whatever the corpus.
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(pack_histogram(counts, capacity), capacity)
    ranked = cut_up.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), where[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(deal, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
