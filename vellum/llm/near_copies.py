"""Near copies by the Jaccard similarity of word shingles: banded minima find pairs, whole sets verify them.

Texts with equal shingle sets are one class from the start. Each class gets BANDS keys, each made of
ROWS minima of the set under different mixings; two classes of similarity s share at least one key
with probability 1 - (1 - s^ROWS)^BANDS, so at 0.8 a pair is missed 3 times in a million, at 0.9 less
than once in 10^12. Classes that share a key are compared on their whole sets, and only a similarity
of LEAST or more links them. Callers may add groups of classes that meet in the same way, such as
those of op9's fingerprints. Keys with the very same members count once. Members of a key with more
than TOKENS shingles are dealt in pairs of sub-blocks; in a block those already linked aren't compared
again, and a task returns a spanning forest of the links, never all pairs.

Defined cases: null and empty texts have the empty set and are one class; a text shorter than a
shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize, small_batches, texts

WORDS, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS = 32, 5
#: Shingles of a sub-block of a large key (8 bytes each); hashes mixed at a time.
TOKENS, AT_ONCE = 400_000, 2048
_RNG = np.random.default_rng(80)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles, as unsigned integers."""
    w = text.encode("utf-8").lower().split()  # words as in the fingerprints
    if not w:
        return np.zeros(0, np.uint64)
    each = set(map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(seed)), dtype=np.uint64))


def digest(s: np.ndarray) -> int:
    """One signed long for a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def band_keys(s: np.ndarray) -> np.ndarray:
    """The set's BANDS keys (signed)."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), AT_ONCE):
        np.minimum(least, ((s[i : i + AT_ONCE, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, mark: Callable[[str], int], words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (digest of the shingle set), its size and its keys, for every text; mark: an unsigned number of the text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).to_pylist()
            sets = [shingles(t, words, seed) for t in whole]
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.zeros(0, np.int64)
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            columns = [batch.column(0), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys)), pa.array(np.array([mark(t) for t in whole], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "size", "keys", "mark"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, fp long, size long, keys array<long>, mark long")


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Spanning edges of the pairs of sets with at least that similarity."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(size)[:-1]]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    mine, label, edges = np.zeros(len(values), bool), np.arange(n), []
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = code[starts[i] : starts[i] + size[i]]
        mine[own] = True
        shared = np.add.reduceat(mine[code[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        mine[own] = False
        for j in i + 1 + np.flatnonzero(shared >= least * (size[i] + size[i + 1 :] - shared) - 1e-9):
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """fp and shingle set of the wanted classes (rep: a document that has it, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps = [], []
            for text, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, words, seed)
                if digest(s) == fp:  # ids may repeat
                    sets.append(s.view(np.int64))
                    fps.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "s"])

    rows = texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "fp")
    return rows.mapInArrow(run, "fp long, s array<long>").dropDuplicates(["fp"])


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int = WORDS, seed: int = SEED, least: float = LEAST) -> DataFrame:
    """Edges (a, b) that connect the classes (fp, rep, size, keys) linked by chains of similar pairs.

    groups: fp, v (distinct): further classes that are compared with each other, those of equal v.
    """
    keyed = classes.where("size > 0").select("fp", "size", F.posexplode("keys").alias("t", "v"))
    keyed = keyed.unionByName(classes.where("size > 0").join(groups, "fp").select("fp", "size", F.lit(BANDS).alias("t"), "v"))
    met = keyed.groupBy("t", "v").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("n > 1")
    once = met.groupBy("n", "tokens", "x", "y").agg(F.min(F.struct("t", "v")).alias("k")).select("k.t", "k.v", "tokens")
    members = keyed.join(materialize(once, "keys"), ["t", "v"])
    members = members.withColumn("subs", F.ceil(F.col("tokens") / TOKENS).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    members = materialize(members.select("t", "v", "fp", "subs", "own"), "members")
    wanted = members.select("fp").distinct().join(classes.select("fp", "rep"), "fp")
    sets = materialize(sets_of(docs, wanted, words, seed), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    dealt = members.select("fp", "t", "v", "own", other.alias("other")).select("fp", "t", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, sets = None, [], []

        def out() -> list[tuple[int, int]]:
            return [(fps[a], fps[b]) for a, b in linked(sets, least)] if len(fps) > 1 else []

        for batch in batches:
            edges = []
            s, keys = batch.column(5), list(zip(*(batch.column(i).to_pylist() for i in range(1, 5))))
            for r, (fp, k) in enumerate(zip(batch.column(0).to_pylist(), keys)):
                if k != key:  # a key may go on in the next batch
                    edges += out()
                    key, fps, sets = k, [], []
                fps.append(fp)
                sets.append(s[r].values.to_numpy().copy())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])
        edges = out()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    rows = dealt.join(sets, "fp").select("fp", "t", "v", "i", "j", "s").repartition("t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j")
    return rows.mapInArrow(run, "a long, b long")
