"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Terms are all words that a labelled example holds; words that no example holds have no place in that
space. IDF comes from all documents. A term's weight is its IDF times one plus the square root of
what its log-likelihood ratio with the label has beyond chance (twice the log of the number of
terms): the label only weighs terms, it drops none.

The examples stand in blocks of BLOCK similar ones. Rare terms have inverted lists, which give each
example's exact part of the cosine; for each frequent term (one in FREQUENT examples or more) each
block keeps the largest weight, which bounds what the frequent terms can add there. Blocks that
no query of a group needs are skipped. The others get their frequent terms added in single precision
(a product for the whole group), and what rounding may hide among the k nearest gets them
again exactly, so the neighbours are exact. They vote by the inverse of their distance; a
logistic curve fitted on examples, each judged by the others, turns shares of votes into
probabilities, and the neighbours are the evidence. The index holds at most `bound` whole texts.

Examples are at most `bound` labelled rows of the training folds (the smallest id hashes). Defined
cases: null and empty texts, and texts without a term, get the score of the label's share; without
labelled rows every score is 0.5 (predicted 1); with labels of one kind only, every score is the
smoothed share; ties go to the example with the smaller doc_id; equal rows give equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import held_out, labelled_sample, one_blas_thread, small_batches, table, texts

#: Labelled examples, neighbours, examples a block, threshold of the prediction.
BOUND, NEIGHBOURS, BLOCK, THRESHOLD = 20_000, 15, 32, 0.5
#: A term of one in so many examples is frequent; entries of a short list; queries scored together; rounding of a product or sum in single precision.
FREQUENT, SHORT, TOGETHER, ROUNDED = 12, 64, 64, 2.0**-23
#: A vote's weight is cosine^2 / (1 - cosine + NEAR); weight of the label's share; examples that the curve is fitted on.
NEAR, PRIOR, CURVE = 0.05, 0.01, 2_000
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return plain.translate(_LATIN).decode("latin-1").split()


class Vocabulary:
    """Numbers of the examples' words."""

    def __init__(self, words: list[str]):
        self.words = words

    def __getstate__(self):
        return "\n".join(self.words)

    def __setstate__(self, state):
        self.words = state.split("\n") if state else []

    @property
    def number(self) -> dict[str, int]:
        if "_number" not in self.__dict__:
            self._number = {w: i for i, w in enumerate(self.words)}
        return self._number

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and how often each stands in it."""
        counts = Counter(words_of(text))
        found = np.array(list(map(self.number.get, counts, repeat(-1))), np.int64)
        n = np.array(list(counts.values()), np.float64)
        return found[found >= 0], n[found >= 0]


def label_weight(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """1 + sqrt of the log-likelihood ratio of term and label beyond chance."""
    n, met = all_pos + all_neg, pos + neg

    def part(seen, row, column):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen * n / (row * column)), 0.0)

    ratio = 2 * (part(pos, met, all_pos) + part(neg, met, all_neg) + part(all_pos - pos, n - met, all_pos) + part(all_neg - neg, n - met, all_neg))
    return 1 + np.sqrt(np.maximum(ratio - 2 * math.log(max(len(met), 2)), 0.0))


def alike(vectors: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which similar ones stand together: halved along their widest direction, again and again."""
    done, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        x = vectors[rows] - vectors[rows].mean(axis=0)
        along = np.ones(x.shape[1])
        for _ in range(6):
            along = x.T @ (x @ along)
            norm = np.linalg.norm(along)
            if norm == 0:
                along = np.eye(1, x.shape[1])[0]
                break
            along /= norm
        half = len(rows) // 2 // size * size or size
        rows = rows[np.argsort(x @ along, kind="stable")]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class NearestExamples:
    """Exact cosine neighbours among examples given as (example, term, count) entries, ordered by example.

    Only what can't be worked out again is sent to the workers; each prepares lists and maxima once.
    """

    def __init__(self, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, count: np.ndarray, neighbours: int = NEIGHBOURS):
        self.weight, self.neighbours, n = weight, neighbours, len(ids)
        # A sketch of each example, by which similar ones come into one block.
        norm, sketch = np.zeros(n), np.zeros(n * 32)
        for lo in range(0, len(term), 1 << 20):
            at, t = example[lo : lo + (1 << 20)], term[lo : lo + (1 << 20)].astype(np.int64)
            value = (1 + np.log(count[lo : lo + (1 << 20)])) * weight[t]
            norm += np.bincount(at, weights=value**2, minlength=n)
            mixed = t * 0x9E3779B1 & 0xFFFFFFFF
            sketch += np.bincount(at.astype(np.int64) * 32 + (mixed >> 27), weights=value * np.where(mixed >> 26 & 1, 1.0, -1.0), minlength=n * 32)
        self.norm = np.sqrt(norm)
        order = alike(sketch.reshape(n, 32) / np.where(norm > 0, self.norm, 1)[:, None], BLOCK)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels, self.norm = ids[order].astype(np.int64), labels[order].astype(np.float64), self.norm[order]
        by = np.argsort(term.astype(np.int64) * n + place[example])
        self.entries = place[example[by]].astype(np.min_scalar_type(max(n, 1))), count[by].astype(np.min_scalar_type(int(count.max()) if len(count) else 1))
        self.start = np.searchsorted(term[by], np.arange(len(weight) + 1)).astype(np.int32 if len(term) < 1 << 31 else np.int64)
        self.share = float(self.labels.mean()) if n else 0.5

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries that are read by number: where each term's begin, examples, weights but for term and norm.

        Those of short lists, and what repeated words add in long ones.
        """
        long = np.repeat(np.diff(self.start) > SHORT, np.diff(self.start))
        at = np.flatnonzero(~long | (self.entries[1] > 1))
        return np.searchsorted(at, self.start).astype(self.start.dtype), self.entries[0][at], np.log(self.entries[1][at].astype(np.float64)) + ~long[at]

    @cached_property
    def terms(self) -> np.ndarray:
        """Weights of the frequent terms, by row."""
        of = self.frequent[0]
        return self.weight[of >= 0]

    @cached_property
    def scale(self) -> np.ndarray:
        """One over each example's norm, 0 where it has none or there is no example."""
        return np.concatenate([np.divide(1, self.norm, out=np.zeros(len(self.norm)), where=self.norm > 0), np.zeros(self.blocks * BLOCK - len(self.norm))])

    @cached_property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each frequent term (-1: rare), their counts by example, and as rows of terms in single precision: weights by
        example, largest weights by block; where a term's examples stand on average."""
        (held, count), start, n = self.entries, self.start, len(self.ids)
        often = np.flatnonzero(np.diff(start) * FREQUENT >= max(n, 1))
        row, home = np.full(len(self.weight), -1, np.int64), np.zeros(len(often))
        row[often] = np.arange(len(often))
        counts = np.zeros((len(often), self.blocks * BLOCK), count.dtype)
        dense = np.zeros(counts.shape, np.float32)
        for i, t in enumerate(often):
            at, c = held[start[t] : start[t + 1]], count[start[t] : start[t + 1]]
            counts[i, at] = c
            dense[i, at] = (1 + np.log(c.astype(np.float64))) * self.weight[t] * self.scale[at]
            home[i] = at.mean() if len(at) else 0
        return row, counts.T, dense, dense.reshape(len(often), self.blocks, BLOCK).max(axis=2, initial=0.0), home

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("short", "terms", "scale", "frequent", "blocks")}

    def vector(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weight[t]
        return w / np.sqrt((w**2).sum())

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, places of the examples) for each query (terms, counts), nearest first; without: ids that don't count."""
        one_blas_thread()
        of, _, dense, _, home = self.frequent
        heavy, light, key = np.zeros((len(queries), len(dense))), [], np.zeros(len(queries))
        for i, (t, n) in enumerate(queries):
            w, row = self.vector(t, n) if len(t) else n, of[t]
            often = row >= 0
            heavy[i, row[often]] = w[often]
            light.append((t[~often], w[~often]))
            if often.any():
                key[i] = w[often] @ home[row[often]] / w[often].sum()
        out = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        if not len(self.ids):
            return out
        # Queries whose frequent terms stand in the same part of the index go together.
        asked = [i for i in np.argsort(key, kind="stable").tolist() if len(queries[i][0])]
        for lo in range(0, len(asked), TOGETHER):
            some = asked[lo : lo + TOGETHER]
            for i, found in zip(some, self._best(heavy[some], [light[i] for i in some], [without[i] for i in some] if without else None)):
                out[i] = found
        return out

    def _rare(self, t: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """Each example's part of the cosine from rare terms: long lists are read as slices, short ones and repeats by number."""
        w = w * self.weight[t]
        start, few, value = self.short
        begin = start[t]
        n = start[t + 1] - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin, end = self.start[t], self.start[t + 1]
        long = np.flatnonzero(end - begin > SHORT)
        begin, end = begin[long], end[long]
        held = self.entries[0]
        examples = np.concatenate([few[at], *[held[a:b] for a, b in zip(begin.tolist(), end.tolist())]])
        weights = np.repeat(np.concatenate([w, w[long]]), np.concatenate([n, end - begin]))
        weights[: len(at)] *= value[at]
        return np.bincount(examples, weights, size) * self.scale

    def _best(self, heavy: np.ndarray, light: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest for queries by the weights of their frequent terms, and terms and weights of the rare ones."""
        _, counts, dense, most, _ = self.frequent
        size, often = self.blocks * BLOCK, np.flatnonzero(heavy.any(axis=0))
        k = self.neighbours + (without is not None)
        every, heavy = heavy.astype(np.float32), heavy[:, often]
        few, slack = every[:, often], ROUNDED * (len(dense) + 4)
        part = np.empty((len(light), size))
        for i, (t, w) in enumerate(light):
            part[i] = self._rare(t, w, size)
        largest = part.reshape(len(part), self.blocks, BLOCK).max(axis=2)
        limit = largest + (few @ most[often]) * (1 + slack) + slack
        # The k-th best block by rare terms alone is what any block has to promise; few skipped blocks don't pay for a copy of the others.
        blocks = np.flatnonzero((limit >= self._nth(largest, k)[:, None]).any(axis=0))
        if 2 * len(blocks) > self.blocks:
            blocks, rows = np.arange(self.blocks), np.arange(size)
            near = every @ dense
            near += part
        else:
            rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            near = few @ dense[often[:, None], rows]
            near += part[:, rows]
        best = near.reshape(len(part), len(blocks), BLOCK).max(axis=2)
        # Sums in single precision are off by less than slack; what may be among the k is added up again.
        least = self._nth(best, k) - 2 * slack
        weight, number = self.terms[often], self.ids
        out = []
        for i in range(len(part)):
            at = (np.flatnonzero(best[i] >= least[i])[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = rows[at[near[i, at] >= least[i]]]
            at = at[at < len(number)]
            if without is not None:
                at = at[number[at] != without[i]]
            mine = np.flatnonzero(heavy[i])
            n = counts[at[:, None], often[mine]].astype(np.float64)
            value = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0) * (heavy[i, mine] * weight[mine])
            score = part[i, at] + value.T.sum(axis=0) * self.scale[at]
            at, score = at[score > 0], score[score > 0]
            order = np.lexsort((number[at], -score))[: self.neighbours]
            out.append((score[order], at[order]))
        return out

    @staticmethod
    def _nth(values: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest of each row; 0 where there are fewer."""
        return np.partition(values, -k, axis=1)[:, -k] if k <= values.shape[1] else np.zeros(len(values))

    def votes(self, near: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of the label in the neighbours' votes."""
        out = np.empty(len(near))
        for i, (cosine, rows) in enumerate(near):
            weight = cosine**2 / np.maximum(1 - cosine + NEAR, NEAR)
            out[i] = (weight @ self.labels[rows] + PRIOR * self.share) / (weight.sum() + PRIOR)
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through smoothed labels (so it stays finite where they part cleanly)."""
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return 0.0, math.log((pos + 1) / (neg + 1))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    form, at = np.stack([x, np.ones(len(x))], axis=1), np.array([0.0, math.log((pos + 1) / (neg + 1))])

    def loss(at: np.ndarray) -> float:
        z = form @ at
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-form @ at))
        slope = form.T @ (p - target)
        step = np.linalg.solve(form.T @ (form * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class ToxicityModel:
    """Vocabulary and examples (a broadcast pair) and the curve from votes to scores.

    kinds is 0 without labels, 1 where they are all of one kind, else 2.
    """

    def __init__(self, shared: Broadcast, kinds: int, curve: tuple[float, float]):
        self.shared, self.kinds, self.curve = shared, kinds, curve

    def judge(self, some: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores and neighbours of texts."""
        words, examples = self.shared.value
        texts = list(dict.fromkeys(some))  # copies are judged once
        near = examples.nearest([words.count(t) for t in texts])
        place = {t: i for i, t in enumerate(texts)}
        at = [place[t] for t in some]
        score = 1 / (1 + np.exp(-(self.curve[0] * examples.votes(near) + self.curve[1])))
        return score[at], [near[i] for i in at]


COUNTED = pa.schema([("word", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())])
HELD = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("t", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def document_frequencies(docs: DataFrame, shared: Broadcast, size: int) -> np.ndarray:
    """In how many documents each word of the (broadcast) vocabulary stands; the last entry is the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df = shared.value.number.get, np.zeros(size + 2, np.int64)
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found += map(get, set(words_of(text)), repeat(size + 1))
            df += np.bincount(np.array(found, np.int64), minlength=size + 2)
            df[size] += batch.num_rows
        df[size + 1] = 0  # words that no example holds
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["t", "n"])

    small_batches(docs.sparkSession)
    counted = texts(docs).select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[counted.column("t").to_numpy()] = counted.column("n").to_numpy()
    return df


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = BOUND) -> ToxicityModel:
    """What reaches the driver is the terms and counts of at most bound examples, and a count for each of their words."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, target, bound).select("doc_id", "text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n[y > 0].update(set(words_of(text)))
        met = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_pydict({"word": met, "neg": [n[0][w] for w in met], "pos": [n[1][w] for w in met]}, schema=COUNTED)

    counted = sample.mapInArrow(count, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).withColumn("met", F.col("neg") + F.col("pos")).toArrow()
    counted = counted.sort_by([("met", "descending"), ("word", "ascending")])  # common words lie together in memory
    words = Vocabulary(counted.column("word").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.count(t) for t in batch.column(1).to_pylist()]
            y = np.array(batch.column(2).to_pylist(), np.int64) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y.astype(np.int32)), pa.array([t for t, _ in found], HELD.field("t").type), pa.array([n for _, n in found], HELD.field("n").type)], schema=HELD)

    held = sample.mapInArrow(terms, "id long, y int, t array<int>, n array<int>").toArrow().sort_by("id").combine_chunks()
    df = document_frequencies(docs, shared, len(words.words)) if len(words.words) else np.zeros(1, np.int64)
    shared.unpersist()
    labelled = held.column("y").to_numpy()
    pos, neg = int((labelled > 0).sum()), int((labelled == 0).sum())
    weight = np.log(1 + (df[-1] + 1) / (df[:-1] + 1)) * label_weight(counted.column("pos").to_numpy().astype(np.float64), counted.column("neg").to_numpy().astype(np.float64), pos, neg)
    term, count = (held.column(c).combine_chunks() if held.num_rows else pa.array([], HELD.field(c).type) for c in ("t", "n"))
    example = np.repeat(np.arange(held.num_rows, dtype=np.int32), term.value_lengths().to_numpy()) if held.num_rows else np.zeros(0, np.int32)
    near = NearestExamples(weight, held.column("id").to_numpy(), labelled, example, term.flatten().to_numpy(), count.flatten().to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((words, near))  # at most bound whole texts' terms
    if not (pos and neg):
        return ToxicityModel(shared, int(bool(pos or neg)), (0.0, math.log((pos + 1) / (neg + 1))))
    return ToxicityModel(shared, 2, fit_curve(sample, shared))


def fit_curve(sample: DataFrame, shared: Broadcast, examples: int = CURVE) -> tuple[float, float]:
    """The curve from votes to scores, fitted on at most so many examples (by id hashes), each judged by the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, near = shared.value
        for batch in batches:
            found = near.nearest([words.count(t) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.votes(found)), batch.column(2)], names=["id", "v", "y"])

    some = sample.orderBy(F.xxhash64(F.lit("curve"), "doc_id"), "doc_id").limit(examples).repartition(8, "doc_id")
    judged = some.mapInArrow(run, "id long, v double, y int").toArrow().sort_by("id")
    return logistic(judged.column("v").to_numpy(), (judged.column("y").to_numpy() > 0).astype(np.float64))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the nearest examples with their cosines and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = model.shared.value[1]
        for batch in batches:
            score, near = model.judge(batch.column(1).to_pylist())
            evidence = [",".join(f"{examples.ids[r]}:{s:.3f}:{int(examples.labels[r])}" for s, r in zip(cosine[:3], rows[:3])) for cosine, rows in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, pa.string())], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    small_batches(docs.sparkSession)
    return texts(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target: str = "toxic") -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they are.

    Where the labelled rows aren't of both kinds, nothing is known and all rows stay.
    """
    model = fit(docs, labels, target)
    if model.kinds < 2:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = model.judge([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
