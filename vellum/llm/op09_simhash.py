"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint is the bitwise majority of its word shingles' hashes. Equal fingerprints
are one class from the start. Fingerprints within d bits of each other agree on b - d of b blocks,
so they meet in at least one of the buckets that choose b - d blocks. In a bucket the distances to
many reference fingerprints (pivots) are computed once; a pair whose distances to any pivot differ
by more than d is discarded, since the triangle inequality puts it more than d bits apart, and only
the survivors are compared. (Pivots alone give no equality key to shuffle by: among 64 even bits a
pivot leaves about half of all pairs, so they work inside buckets.) Buckets above SUB rows are
dealt in pairs of sub-blocks. A task returns a spanning forest of the links it found, never all
pairs; the components come from joins over those edges.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal rows have
equal fingerprints; a component's id is its least doc_id, a null one not counting (null if there
is no other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.llm import near_copies
from vellum.llm.common import materialize, small_batches, table, texts
from vellum.llm.components import components

WORDS, SEED, MAX_BITS = 4, 42, 4
#: Rows of a sub-block of a large bucket; buckets up to SMALL rows are compared row by shifted row.
SUB, SMALL = 2048, 32
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Hashes whose bits are counted at a time.
BITS_AT_ONCE = 8192
#: Large buckets that may be sent to every executor as a table (24 bytes each).
HOT_KEYS = 100_000


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of all shingles' XXH64, as an unsigned integer."""
    w = text.encode("utf-8").lower().split()  # of bytes: A-Z, and U+0009 to U+000D and U+0020, only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BITS_AT_ONCE):
        some = h[i : i + BITS_AT_ONCE]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (fp, a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def masks(distinct: int, bits: int = MAX_BITS) -> list[int]:
    """Masks of the blocks that a bucket key keeps: more blocks, so longer keys, for more fingerprints."""
    blocks = bits + (2 if distinct < 1 << 24 else 3 if distinct < 1 << 30 else 4)
    ends = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - bits)]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (indexes of the least member) after linking a[i] with b[i]."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def close(a: np.ndarray, b: np.ndarray, fp: np.ndarray, dist: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a[i], b[i] those within so many bits: pivots first, then the fingerprints."""
    for p in range(0, dist.shape[1], 4):
        if not len(a):
            return a, b
        keep = (np.abs(dist[a, p : p + 4] - dist[b, p : p + 4]) <= bits).all(axis=1)
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[keep], b[keep]


def forest(group: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside groups (equal values of group stand together)."""
    n = len(fp)
    dist = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= SMALL, sizes)
    label = np.arange(n)
    for lag in range(1, min(SMALL, n)):
        a = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        if not len(a):
            break
        label = unite(label, *close(a, a + lag, fp, dist, bits))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        order = start + np.argsort(dist[start : start + size, 0], kind="stable")
        first = dist[order, 0]
        for i in range(0, size, 256):
            rows = order[i : i + 256]
            others = order[i : np.searchsorted(first, first[min(i + 256, size) - 1] + bits, side="right")]
            near = np.ones((len(rows), len(others)), bool)
            for p in range(4):
                near &= np.abs(dist[rows, p][:, None] - dist[others, p]) <= bits
            near &= label[rows][:, None] != label[others]
            x, y = np.nonzero(near)
            for k in range(0, len(x), 1 << 18):
                a, b = rows[x[k : k + (1 << 18)]], others[y[k : k + (1 << 18)]]
                apart = label[a] != label[b]
                label = unite(label, *close(a[apart], b[apart], fp, dist, bits))
    at = np.flatnonzero(label != np.arange(n))
    return fp[at], fp[label[at]]


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp) linked by chains of close pairs."""
    kept = masks(distinct.count(), bits)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in kept]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "v"))
    hot = materialize(keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > SUB), "hot")
    many = hot.count()
    if many:
        keyed = keyed.join(F.broadcast(hot) if many <= HOT_KEYS else hot, ["t", "v"], "left")
        subs = F.ceil(F.coalesce("n", F.lit(1)) / SUB).cast("int")
        keyed = keyed.withColumn("subs", subs).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
        keyed = keyed.select("fp", "t", "v", "own", other.alias("other")).select("fp", "t", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        keyed = keyed.select("fp", "t", "v", F.lit(0).alias("i"), F.lit(0).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(part: np.ndarray) -> pa.RecordBatch:
            keys = part[1:]
            group = np.cumsum(np.r_[0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if part.shape[1] else np.zeros(0, np.int64)
            a, b = forest(group, part[0].view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)]))
            if sum(x.shape[1] for x in held) < 20_000:
                continue
            part = np.ascontiguousarray(np.concatenate(held, axis=1))
            ends = np.flatnonzero((part[1:, 1:] != part[1:, :-1]).any(axis=0))
            if len(ends):  # the last group may go on in the next batch
                yield out(np.ascontiguousarray(part[:, : ends[-1] + 1]))
                part = np.ascontiguousarray(part[:, ends[-1] + 1 :])
            held = [part]
        if held:
            yield out(np.ascontiguousarray(np.concatenate(held, axis=1)))

    dealt = keyed.repartition("t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j")
    return dealt.select("fp", "t", "v", "i", "j").mapInArrow(run, "a long, b long")


def with_components(fps: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for documents (doc_id, fp), classes (fp, rep) and edges between fps."""
    roots = components(edges)
    linked = roots.join(classes, roots.node == classes.fp).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    of = classes.join(linked.join(least, "root").select("fp", "least"), "fp", "left")
    of = of.select("fp", F.coalesce("least", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    fps = materialize(fingerprints(docs, words, seed), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    return with_components(fps, classes, links(classes.select("fp"), bits))


def groups(found: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """fp, v: shingle sets (fp) by the component of their texts' fingerprints (mark); a set may have several."""
    held = materialize(found.where("size > 0").select("fp", "mark").distinct(), "marks")
    roots = components(links(materialize(held.select(F.col("mark").alias("fp")).distinct(), "fingerprints"), bits))
    of = held.join(roots, held["mark"] == roots["node"], "left").select("fp", F.coalesce("root", "mark").alias("v"))
    return materialize(of.distinct(), "groups")


def near_copies_of(docs: DataFrame, words: int = near_copies.WORDS, seed: int = SEED, least: float = near_copies.LEAST) -> DataFrame:
    """doc_id, fp (of the shingle set) and component_id of every document, linked by shingle similarity.

    Documents meet whose fingerprints op9 links, and those that share minima; their whole sets decide.
    """
    found = materialize(near_copies.signatures(docs, fingerprint, words, seed), "signatures")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys")), "classes")
    edges = near_copies.links(docs, classes, groups(found), words, seed, least)
    return with_components(found.select("doc_id", "fp"), classes.select("fp", "rep"), edges)


def keep_one(docs: DataFrame, words: int = near_copies.WORDS, seed: int = SEED, least: float = near_copies.LEAST) -> DataFrame:
    """docs without all but one document of each component (that with the least doc_id).

    Documents are linked by the similarity of their word shingles. Those within op9's 4 bits are found by
    fingerprints and pivots, the similar ones that lie further apart by their minima (near_copies).
    Of rows that share that doc_id too, one stays; documents without doc_id stay only where their
    component has no other.
    """
    found = materialize(near_copies_of(docs, words, seed, least), "found")
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"))).alias("k"))
    best = materialize(best.select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp")), "kept")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    kept = docs.join(best, docs.doc_id.eqNullSafe(best["_id"]), "left_semi")
    if not twice:
        return kept
    small_batches(docs.sparkSession)
    # Only where ids repeat: the row's own set settles which of its rows is meant.
    names = list(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [near_copies.digest(near_copies.shingles(t or "", words, seed)) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*names, "_fp"])

    rows = kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("_fp", LongType())]))
    rows = rows.join(best, rows["doc_id"].eqNullSafe(best["_id"]) & (rows["_fp"] == best["_fp"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_fp"]).select(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
