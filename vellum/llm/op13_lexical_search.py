"""Ranked lexical search by branch and bound over max trees of document ranges.

Documents are indexed in blocks of a task's consecutive rows. A block holds, for every query term
in it, the postings and the largest impact in each leaf (a range of LEAF documents), in each range
of FAN leaves, and in the block. A query's bound on a range is the sum of its terms' largest impacts
there by their weights. Search goes down from the ranges of the highest bounds, scores the documents
of the leaves it opens, and stops where a bound falls below the score that the k best so far have;
ranges whose bound equals it are opened too, as a smaller doc_id wins a tie.

Each query first searches the blocks with its highest bounds; the k-th best score found there holds
for all other blocks. A task returns k rows a query at most.

Queries are the stated set: they go to the tasks in batches of at most QUERY_BYTES of terms, a search
over all rows each. A term's impact in a document doesn't depend on the query.

Defined cases: null and empty texts and those without a term are no documents and no queries; items
that share an id (null is one, too) are one query with all their terms; rows that share a doc_id are
documents of their own; a null doc_id comes first among equal scores; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, small_batches, table

TOP = 50
#: Documents of a leaf, leaves of a range above it, documents and about the postings of a block.
LEAF, FAN, BLOCK, BLOCK_POSTINGS = 32, 8, 2048, 1 << 20
#: Bytes of the terms of one batch of queries; blocks that a query searches first.
QUERY_BYTES, SEEDS = 4 << 20, 2
NO_ID = -(2**63)
#: ASCII letters in lower case, other letters and digits as they are, everything else a blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass
class Queries:
    """A batch of queries: item ids, the terms of all, and each query's terms as numbers (terms[starts[q]:starts[q + 1]])."""

    ids: list[int | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    terms: np.ndarray = None
    starts: np.ndarray = None
    weights: np.ndarray = None  # by place in terms, once document counts are known

    def weigh(self, n: int, df: np.ndarray) -> None:
        w = np.asarray([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        self.weights = w[self.terms]


def batches_of(items: DataFrame, most: int = QUERY_BYTES) -> Iterator[Queries]:
    """The queries in batches; rows come to the driver one after the other, and a batch is all it holds."""
    text = F.concat_ws(" ", F.collect_list("text")).cast("binary")
    asked, lists, size = Queries(), [], 0

    def done() -> Queries:
        asked.terms = np.asarray([t for of in lists for t in of], dtype=np.int64)
        asked.starts = np.cumsum([0, *map(len, lists)])
        return asked

    for item_id, body in items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(text.alias("text")).toLocalIterator():
        found = dict.fromkeys(terms_of(bytes(body)))
        if not found:
            continue
        more = sum(map(len, found)) + 8 * len(found)
        if lists and size + more > most:
            yield done()
            asked, lists, size = Queries(), [], 0
        asked.ids.append(item_id)
        lists.append([asked.vocabulary.setdefault(t, len(asked.vocabulary)) for t in found])
        size += more
    if lists:
        yield done()


RAW = "block long, n_docs long, n_terms long, ids binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"


def raw_blocks(docs: DataFrame, vocabulary: dict[bytes, int], block: int = BLOCK) -> DataFrame:
    """Blocks of a task's documents that hold a query term: their ids, numbers of terms, and postings by term.

    n_docs and n_terms count all documents read since the block before, with or without a query term.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, part, nth = known.value.get, TaskContext.get().partitionId() << 32, 0
        ids, sizes, found, tfs, lengths, n_docs, n_terms = [], [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            term, tf = np.asarray(found, dtype=np.int32), np.asarray(tfs, dtype=np.int32)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)
            order = np.lexsort((doc, term))
            terms, counts = np.unique(term, return_counts=True)
            row = [part + nth, n_docs, n_terms, *(x.tobytes() for x in (np.asarray(ids, dtype=np.int64), np.asarray(sizes, dtype=np.int64), terms, counts.astype(np.int32), doc[order], tf[order]))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[c.split()[0] for c in RAW.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                n_docs, n_terms, before = n_docs + 1, n_terms + len(words), len(found)
                for t, n in Counter(words).items():
                    if (k := get(t)) is not None:
                        found.append(k)
                        tfs.append(n)
                if len(found) > before:
                    ids.append(NO_ID if doc_id is None else doc_id)
                    sizes.append(len(words))
                    lengths.append(len(found) - before)
                    if len(ids) == block or len(found) >= BLOCK_POSTINGS:
                        yield close()
                        nth += 1
                        ids, sizes, found, tfs, lengths, n_docs, n_terms = [], [], [], [], [], 0, 0
        if n_docs:
            yield close()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, RAW), "lexical-blocks")


def totals(blocks: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all of them, and documents with each query term (as many counts as the batch has terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = np.zeros(size, np.int64)
    for term, count in blocks.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = count
    return n or 0, total or 0, df


INDEX = "block long, ids binary, terms binary, counts binary, docs binary, impacts binary, roots binary, leaf_counts binary, leaves binary, maxima binary"


def max_trees(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The index: postings with impacts, and per term the largest impact of the block (roots) and of each leaf that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes, counts = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["counts"], np.int32)
                docs, tf = np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["tfs"], np.int32).astype(np.int64)
                m = 50 + 50 * sizes * n // total
                impacts = (1_000_000_000 * tf // (1000 * tf + 20 * m[docs])).astype(np.int32)
                term = np.repeat(np.arange(len(counts)), counts)
                leaf = docs // LEAF
                first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (leaf[1:] != leaf[:-1])])) if len(docs) else np.zeros(0, np.int64)
                maxima = np.maximum.reduceat(impacts, first) if len(first) else impacts
                roots = np.maximum.reduceat(impacts, np.cumsum(counts) - counts) if len(counts) else impacts
                row = [r["block"], r["ids"], r["terms"], r["counts"], r["docs"], *(x.tobytes() for x in (impacts, roots, np.bincount(term[first], minlength=len(counts)).astype(np.int32), leaf[first].astype(np.uint16), maxima))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[c.split()[0] for c in INDEX.split(", ")])

    return materialize(blocks.where("length(docs) > 0").mapInArrow(run, INDEX), "lexical-index")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Block:
    """One block of the index, searched query by query."""

    def __init__(self, row: dict, least_leaf: int = LEAF):
        read = lambda name, t: np.frombuffer(row[name], t)
        self.ids, self.terms, self.docs, self.impacts = read("ids", np.int64), read("terms", np.int32), read("docs", np.uint16), read("impacts", np.int32).astype(np.int64)
        self.roots, self.leaves, self.maxima = read("roots", np.int32).astype(np.int64), read("leaves", np.uint16).astype(np.int64), read("maxima", np.int32).astype(np.int64)
        counts, leaf_counts = read("counts", np.int32).astype(np.int64), read("leaf_counts", np.int32).astype(np.int64)
        self.first_leaf, self.leaf_counts = np.cumsum(leaf_counts) - leaf_counts, leaf_counts
        # Where the postings of each (term, leaf) begin.
        term = np.repeat(np.arange(len(counts)), counts)
        leaf = self.docs // LEAF
        edge = np.flatnonzero((term[1:] != term[:-1]) | (leaf[1:] != leaf[:-1])) + 1
        self.begin = np.concatenate([[0], edge])
        self.size = np.diff(np.append(self.begin, len(self.docs)))
        self.n_leaves = -(-len(self.ids) // LEAF)
        self.n_ranges = -(-self.n_leaves // FAN)
        self.place = None

    def bounds(self, asked: Queries) -> np.ndarray:
        """Every query's bound on the block."""
        root = np.zeros(len(asked.vocabulary), np.int64)
        root[self.terms] = self.roots
        return np.add.reduceat(asked.weights * root[asked.terms], asked.starts[:-1])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the block's documents that may be among the best; terms: numbers of the query's terms."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0)
        rows, w = at[here], weights[here]
        if not len(rows):
            return
        sizes = self.leaf_counts[rows]
        entries = ranges(self.first_leaf[rows], sizes)
        of = np.repeat(np.arange(len(rows)), sizes)
        tree = np.zeros((len(rows), self.n_ranges * FAN), np.int64)
        tree[of, self.leaves[entries]] = self.maxima[entries]
        slot = np.full(tree.shape, -1, np.int64)
        slot[of, self.leaves[entries]] = entries
        upper = tree.reshape(len(rows), self.n_ranges, FAN).max(axis=2)
        open_ = [(-b, -1, r) for r, b in enumerate((w @ upper).tolist())]  # (bound, leaf or -1, range): highest bound first
        heapq.heapify(open_)
        while open_:
            bound, leaf, of_range = heapq.heappop(open_)
            if -bound < best.least:
                return
            if leaf < 0:
                lo = of_range * FAN
                for k, b in enumerate((w @ tree[:, lo : lo + FAN]).tolist()):
                    if b >= best.least and b > 0:
                        heapq.heappush(open_, (-b, lo + k, of_range))
                continue
            some = slot[:, leaf]
            have = some >= 0
            some = some[have]
            postings = ranges(self.begin[some], self.size[some])
            scores = np.zeros(LEAF, np.int64)
            np.add.at(scores, self.docs[postings] - leaf * LEAF, np.repeat(w[have], self.size[some]) * self.impacts[postings])
            hit = np.flatnonzero(scores >= max(best.least, 1))
            best.add(scores[hit], self.ids[leaf * LEAF + hit])


class Best:
    """The k best (score, doc_id) so far; least: the score that a document must reach."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.least = k, max(least, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def first_blocks(index: DataFrame, asked: Queries, n: int = SEEDS) -> DataFrame:
    """q, block: the blocks with each query's highest bounds."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, blocks, bounds = shared.value, [], []
        root = np.zeros(len(asked.vocabulary), np.int64)
        for batch in batches:
            for block, terms, roots in zip(*(c.to_pylist() for c in batch.columns)):
                root[:] = 0
                root[np.frombuffer(terms, np.int32)] = np.frombuffer(roots, np.int32)
                blocks.append(block)
                bounds.append(np.add.reduceat(asked.weights * root[asked.terms], asked.starts[:-1]))
                if len(blocks) > 64:
                    blocks, bounds = keep(blocks, bounds)
        if blocks:
            blocks, bounds = keep(blocks, bounds)
            of = np.asarray(blocks)
            q = np.tile(np.arange(len(asked.ids)), (len(of), 1))
            yield pa.RecordBatch.from_arrays([pa.array(q.ravel()), pa.array(np.repeat(of, len(asked.ids))), pa.array(np.asarray(bounds).ravel())], names=["q", "block", "bound"])

    def keep(blocks: list, bounds: list) -> tuple[list, list]:
        """Only blocks that are among some query's first n."""
        top = np.unique(np.argsort(-np.asarray(bounds), axis=0, kind="stable")[:n])
        return [blocks[i] for i in top], [bounds[i] for i in top]

    found = index.select("block", "terms", "roots").mapInArrow(run, "q long, block long, bound long")
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    return found.where("bound > 0").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("q", "block")


FOUND = "q long, doc_id long, score long"


def search_blocks(index: DataFrame, asked: Queries, least: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """q, doc_id, score: the k best a query and task; only: the queries to ask of each block (else all)."""
    shared = index.sparkSession.sparkContext.broadcast((asked, least, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least, only = shared.value
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                block = Block(row)
                bounds = block.bounds(asked)
                for q in range(len(asked.ids)) if only is None else only.get(row["block"], []):
                    if bounds[q] < max(least[q], 1):
                        continue
                    mine = best.setdefault(q, Best(k, int(least[q])))
                    if bounds[q] >= mine.least:
                        lo, hi = asked.starts[q], asked.starts[q + 1]
                        block.search(asked.terms[lo:hi], asked.weights[lo:hi], mine)
        for q, b in best.items():
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), q)), pa.array(b.ids, mask=b.ids == NO_ID), pa.array(b.scores)], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, most: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents with the highest scores."""
    spark, out = docs.sparkSession, None
    for asked in batches_of(items, most):
        raw = raw_blocks(docs, asked.vocabulary, block)
        n, total, df = totals(raw, len(asked.vocabulary))
        asked.weigh(n, df)
        index = max_trees(raw, n, total)
        # As many pairs as a batch has queries, SEEDS times.
        seeds: dict[int, list[int]] = {}
        for q, b in first_blocks(index, asked).collect():
            seeds.setdefault(b, []).append(q)
        least = np.zeros(len(asked.ids), np.int64)
        chosen = index.join(F.broadcast(spark.createDataFrame([(b,) for b in seeds], "block long")), "block", "left_semi")
        for q, score in best_of(search_blocks(chosen, asked, least, k, seeds), k).where(F.col("rank") == k).select("q", "score").collect():
            least[q] = score
        ids = spark.createDataFrame(list(enumerate(asked.ids)), "q long, item_id long")
        hits = best_of(search_blocks(index, asked, least, k), k).join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
