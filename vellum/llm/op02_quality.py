"""Document quality by a generalised additive model with pairwise interactions.

Each text gives a row of counts and shares. Features are cut into bins at training quantiles;
boosting goes round the features, each time fitting a tree of depth two on one feature's bins, and
then round the strongest pairs; adding the leaves up leaves one lookup table per feature and per
pair, so a score is a sum of table entries.

Fitted on at most `bound` labelled rows of the training folds (the smallest id hashes); every
document is scored on its whole text. Defined cases: null and empty texts are scored like any
other (all counts 0); without labelled rows every score is 0.5; equal rows give equal rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import held_out, labelled_sample, small_batches, table, texts

#: Labelled rows to fit on, threshold of the prediction.
BOUND, THRESHOLD = 20_000, 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
NAMES = ("chars", "words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "bars", "distinct", "stutter", "repeated_lines", "sentence_length", "lines", "longest", "short_words")

#: Classes of code points up to U+FFFF: 0 other, 1 upper case, 2 digit, 3 ordinary mark, 4 symbol.
_CLASS = np.zeros(65536, np.uint8)
for _c in range(65536):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s in ".,;:'\"?-()" else 4 if not (_s.isalnum() or _s.isspace()) else 0


def features(text: str) -> list[float]:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kinds = np.bincount(_CLASS[np.minimum(points, 65535)], minlength=5) if len(points) else np.zeros(5)
    words, n = text.split(), max(len(text), 1)
    w = max(len(words), 1)
    lengths = list(map(len, words)) or [0]
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / w,
        kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n,
        text.count("!") / w, text.count("|") / w,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(w / (text.count(".") + 1)), len(lines) / w,
        np.log1p(max(lengths)), sum(x <= 3 for x in lengths) / w,
    ]


def matrix(some: list[str]) -> np.ndarray:
    return np.array([features(t) for t in some], dtype=np.float64).reshape(-1, len(NAMES))


def depth_two(gain_of: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin of a depth-two tree on ordered bins with gradients g and hessians h."""

    def cut(lo: int, hi: int) -> int:
        left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
        if len(left_g) == 0:
            return lo
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
        gain_of[0] = max(gain_of[0], gain.max() - all_g**2 / (all_h + 1))
        return lo + 1 + int(gain.argmax())

    value = np.zeros(len(g))
    mid = cut(0, len(g))
    for lo, hi in ((0, mid), (mid, len(g))):
        at = cut(lo, hi) if hi - lo > 1 else lo
        for a, b in ((lo, at), (at, hi)):
            if b > a:
                value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


class AdditiveModel:
    """Lookup tables over binned features, and over coarsely binned pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        share = y.mean() if n else 0.5
        self.constant = n == 0 or share in (0.0, 1.0)
        self.base = 0.0 if n == 0 else float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(k)] if n else []
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(k)] if n else []
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if self.constant:
            return
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        margin = np.full(n, self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for f in range(k):
                g, h = slopes()
                size = len(self.tables[f])
                step = RATE * depth_two(np.zeros(1), np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
                self.tables[f] += step
                margin += step[bins[f]]
        rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        g, h = slopes()
        strength = []
        for a in range(k):
            for b in range(a + 1, k):
                size = (len(self.coarse[a]) + 1) * (len(self.coarse[b]) + 1)
                cell = rough[a] * (len(self.coarse[b]) + 1) + rough[b]
                strength.append((float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 1)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(strength, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), values in zip(self.pairs, self.pair_tables):
                g, h = slopes()
                cell = rough[a] * values.shape[1] + rough[b]
                gs, hs = (np.bincount(cell, v, values.size).reshape(values.shape) for v in (g, h))
                step = RATE * self.crossed(gs, hs)
                values += step
                margin += step.ravel()[cell]

    @staticmethod
    def crossed(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Best cut along one axis, then each side's best cut along the other; the better axis order wins."""
        best, found = -1.0, np.zeros_like(g)
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            for at in range(1, a.shape[0]):
                value, total = np.zeros_like(a), 0.0
                for part in (slice(0, at), slice(at, None)):
                    gc, hc = np.cumsum(a[part].sum(axis=0)), np.cumsum(b[part].sum(axis=0))
                    gain = gc**2 / (hc + 1) + (gc[-1] - gc) ** 2 / (hc[-1] - hc + 1)
                    c = int(gain.argmax()) + 1
                    total += gain[c - 1]
                    value[part, :c] = gc[c - 1] / (hc[c - 1] + 1)
                    value[part, c:] = (gc[-1] - gc[c - 1]) / (hc[-1] - hc[c - 1] + 1)
                if total > best:
                    best, found = total, value.T if flip else value
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        if not self.constant:
            for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
                margin += values[np.searchsorted(edges, x[:, f], side="right")]
            for (a, b), values in zip(self.pairs, self.pair_tables):
                margin += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = BOUND) -> AdditiveModel:
    """The features (not the texts) of at most bound rows reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, target, bound).select("text", "y").mapInArrow(run, "x array<double>, y int").toArrow()
    # Row order depends on the cluster; a fixed order makes equal models.
    x, y = np.array(rows.column(0).to_pylist(), dtype=np.float64).reshape(-1, len(NAMES)), np.array(rows.column(1).to_pylist(), dtype=np.float64)
    order = np.lexsort((y, *x.T))
    return AdditiveModel(x[order], y[order])


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    return texts(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target: str = "quality") -> DataFrame:
    """docs without the rows whose score is under the threshold; all columns as they are."""
    model, at = fit(docs, labels, target), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
