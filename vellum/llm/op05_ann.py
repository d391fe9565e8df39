"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Rows are dealt to lists by their nearest direction centre, fitted on a bounded sample; the number of
lists grows with the square root of the table. Every row is indexed. A query visits the lists whose
centres (times the list's largest norm) promise most; how many is set on the sample so that TARGET
of the true neighbours lie there. The most promising list comes first and gives a threshold, with
which the others start. Inside a list vectors are rotated at random and read in blocks of columns:
after each block a test on the partial product (its scaled value plus DOUBT standard deviations
under a random rotation) abandons candidates that can't reach the query's threshold, and the
threshold rises as nearer rows turn up. Survivors get their exact product on the original vectors.

Lists and query sets beyond BLOCK rows are dealt in pairs of blocks, so no group grows without
bound. Defined cases: vectors that are null, zero, hold null or non-finite components, or have
another than the commonest length take no part; rows that share a vec_id count once, with their
best score; a null vec_id takes no part; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, one_blas_thread, table

#: Neighbours; rows to fit on; share of true neighbours that the visited lists hold on the sample.
K, BOUND, TARGET = 20, 32_768, 0.97
#: Sample rows a list (at least), rows of a block, rows between two rises of the threshold.
ROWS_A_LIST, BLOCK, CHUNK = 16, 4_096, 1_024
#: Columns read between two tests, standard deviations that a test allows.
COLUMNS, DOUBT = 16, 3.0
FOUND = "query_id long, vec_id long, score double"


def valid(rows: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(ids).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    big = float("inf")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def block_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


class Lists:
    """Rotation, centres and sample; fitted on the driver from at most BOUND rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int, k: int = K):
        rng = np.random.default_rng(5)
        self.k, self.ids, self.x, dim = k, ids, x, x.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = max(1, min(int(rows**0.5), len(x) // ROWS_A_LIST))
        centres = unit[rng.permutation(len(unit))[:lists]]
        for _ in range(8):
            of = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, unit)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
        self.centres = centres
        self.norms = np.ones(len(centres))
        self.probes = len(centres)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T) * self.norms, axis=1, kind="stable")

    def among_sample(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k best of the sample without itself: positions (-1: none) and products."""
        product = q @ self.x.T
        product[self.ids[None, :] == ids[:, None]] = -np.inf
        if len(np.unique(self.ids)) < len(self.ids):  # an id with several vectors counts once
            for i, row in enumerate(product):
                order = np.argsort(-row, kind="stable")
                first = np.unique(self.ids[order], return_index=True)[1]
                again = np.ones(len(row), bool)
                again[order[first]] = False
                row[again] = -np.inf
        k = min(self.k, product.shape[1])
        at = np.argpartition(-product, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(product, at, axis=1)
        return np.where(np.isfinite(value), at, -1), value

    def calibrate(self, target: float = TARGET) -> None:
        """Set how many lists to visit, on every so many-th row of the sample as a query."""
        some = np.arange(0, len(self.x), max(1, len(self.x) // 256))
        at, _ = self.among_sample(self.ids[some], self.x[some])
        place = np.argsort(self.order(self.x[some]), axis=1)
        home = self.lists_of(self.x)
        ranks = np.sort(np.concatenate([place[i][home[a[a >= 0]]] for i, a in enumerate(at)]))
        if len(ranks):
            self.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def best_of(qi: np.ndarray, xi: np.ndarray, score: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best distinct ids, by query, falling score and rising id."""
    order = np.lexsort((x_ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    by = np.lexsort((np.arange(len(qi)), x_ids[xi], qi))
    again = by[1:][(qi[by][1:] == qi[by][:-1]) & (x_ids[xi[by]][1:] == x_ids[xi[by]][:-1])]
    if len(again):  # an id with several vectors counts once, with its best
        qi, xi, score = (np.delete(c, again) for c in (qi, xi, score))
    first = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.zeros(0, bool)
    nth = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
    return qi[nth < k], xi[nth < k], score[nth < k]


def scan(queries: np.ndarray, ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray, k: int = K, doubt: float = DOUBT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, product) of each query's k best in x that aren't abandoned."""
    one_blas_thread()
    dim = x.shape[1]
    qr, xr = queries @ rotation, x @ rotation
    norms, own, floor = np.linalg.norm(x, axis=1), np.linalg.norm(queries, axis=1), floor.copy()
    out: list[tuple] = []
    for lo in range(0, len(queries), 128):
        rows = slice(lo, lo + 128)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(x), CHUNK):
            some = slice(at, at + CHUNK)
            done = min(COLUMNS, dim)
            partial = qr[rows, :done] @ xr[some, :done].T
            # Under a random rotation the scaled partial product strays by about |q||x| / sqrt(done).
            stray = doubt * np.sqrt((1 - done / dim) / done) + 1e-9
            qi, xi = np.nonzero(partial * (dim / done) + stray * own[rows, None] * norms[some] >= floor[rows, None])
            value = partial[qi, xi]
            qi, xi = qi + lo, xi + at
            while done < dim:
                until = min(done + COLUMNS, dim)
                value = value + exact(qr[qi, done:until], xr[xi, done:until])
                done = until
                stray = doubt * np.sqrt((1 - done / dim) / done) + 1e-9
                keep = value * (dim / done) + stray * own[qi] * norms[xi] >= floor[qi]
                qi, xi, value = qi[keep], xi[keep], value[keep]
            keep = x_ids[xi] != ids[qi]
            qi, xi = qi[keep], xi[keep]
            held = best_of(*(np.concatenate(c) for c in zip(held, (qi, xi, exact(queries[qi], x[xi])))), x_ids, k)
            last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True]) if len(held[0]) else np.zeros(0, np.int64)
            last = last[np.bincount(held[0], minlength=len(queries))[held[0][last]] == k]
            floor[held[0][last]] = np.maximum(floor[held[0][last]], held[2][last])  # it rises with the k-th best so far
        out.append((ids[held[0]], x_ids[held[1]], held[2]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(rows: DataFrame, queries: DataFrame, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score for queries and rows of (vec_id, embedding)."""
    spark = rows.sparkSession
    rows, queries = valid(rows), valid(queries)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths[0]["d"], lengths[0]["count"]
    rows, queries = rows.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"]), queries.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(BOUND).toArrow()
    index = Lists(sample.column("vec_id").to_numpy(), block_of(sample.column("v")), n, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block_of(batch.column(1))
            of = index.lists_of(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(np.linalg.norm(x, axis=1))], names=["vec_id", "v", "list", "norm"])

    listed = materialize(rows.mapInArrow(assign, "vec_id long, v array<double>, list int, norm double"), "lists")
    sizes = {r["list"]: r for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}  # a row per list
    index.norms = np.array([sizes[i]["norm"] if i in sizes else 0.0 for i in range(len(index.centres))])
    index.calibrate(target)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            lists = [row for lo in range(0, batch.num_rows, 256) for row in index.order(block_of(batch.slice(lo, 256).column(1)))[:, : index.probes].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    asked = materialize(queries.select("vec_id", "v").mapInArrow(probe, "query_id long, q array<double>, lists array<int>"), "asked")
    index = index.rotation  # all that the scans need of it

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = scan(block_of(b.column("q")), b.column("query_id").to_numpy(), b.column("floor").to_numpy(), block_of(a.column("v")), a.column("vec_id").to_numpy(), index, k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    def visit(visits: DataFrame) -> DataFrame:
        """What queries (query_id, q, floor, list) find in their lists; long lists and many queries meet block by block."""
        many = {r["list"]: r["n"] for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}
        # A row per list: into how many blocks its rows, and the queries that visit it, are dealt.
        parts = spark.createDataFrame([(i, -(-sizes[i]["n"] // BLOCK), -(-n // BLOCK)) for i, n in many.items() if i in sizes], "list int, xs int, qs int")
        left = listed.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("vec_id"), "xs").cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "vec_id", "v")
        right = visits.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("qb"), "query_id", "q", "floor")
        keys = ["list", "xb", "qb"]
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND), "found")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = visit(asked.select("query_id", "q", F.lit(float("-inf")).alias("floor"), F.element_at("lists", 1).alias("list")))
    floors = best(near).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = asked.select("query_id", "q", F.explode(F.slice("lists", 2, 1 << 30)).alias("list")).join(floors, "query_id", "left")
    far = visit(others.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    return best(near.unionByName(far))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
