"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language, fitted by expectation and
maximisation over all segmentations of the training words. A word's probability in a language is
the sum over all its segmentations (forward algorithm); a text's is the product over its words, and
with the languages' shares it gives the posterior that is the score.

Words are runs of letters in lower case, marked at their start as the vocabulary does. Fitted on at
most `bound` rows of the training folds with a language (the smallest id hashes); every whole text
is scored. Defined cases: a null text or one without a letter is `und` with score 0; with no
training rows every text is `und`; ties go to the first language by name; equal rows give equal
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import held_out, materialize, small_batches, table, texts

#: Training rows; rounds of expectation and maximisation.
BOUND, ROUNDS = 6_000, 3
#: Probability of a letter that the vocabulary lacks; pseudo-count of every piece.
UNKNOWN, PRIOR = 1e-7, 0.05
#: Words whose probabilities a worker remembers.
MEMORY = 150_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LATIN = bytes(c if chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    text = text.lower()
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return plain.translate(_LATIN).decode("latin-1").split()


class Pieces:
    """Numbers of the vocabulary's pieces; the one after the last is an unknown letter, then no piece."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]
        names = list(dict.fromkeys(names))
        self.longest = max(map(len, names), default=1)
        self.number = {x: i for i, x in enumerate(names)}
        self.unknown, self.none = len(names), len(names) + 1
        # The pieces' beginnings as nodes: (node, letter) of each step, sorted, and the node it leads to.
        self.letters = np.array(sorted({ord(c) for x in names for c in x}), dtype=np.int64)
        letter = {int(c): i for i, c in enumerate(self.letters)}
        node, steps = {"": 0}, []
        for x in names:
            for k in range(1, len(x) + 1):
                if x[:k] not in node:
                    node[x[:k]] = len(node)
                    steps.append((node[x[: k - 1]] * len(letter) + letter[ord(x[k - 1])], node[x[:k]]))
        self.steps, self.ends = np.array(sorted(steps), dtype=np.int64).reshape(-1, 2).T.copy()
        self.piece = np.full(len(node), self.none, np.int32)
        for x, i in self.number.items():
            self.piece[node[x]] = i

    def grid(self, words: list[str]) -> np.ndarray:
        """[word, end, length]: the piece of that length that ends there; words are of one length."""
        size = len(words[0])
        span = min(size, self.longest)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        letter = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        known = self.letters[letter] == points
        grid = np.full((len(words) * size, span), self.none, np.int32)
        start, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for k in range(span):  # from every start as far as the letters are a piece's beginning
            inside = start % size + k < size
            start, node = start[inside], node[inside]
            at = start + k
            step = node * len(self.letters) + letter[at]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            on = (self.steps[found] == step) & known[at]
            start, node = start[on], self.ends[found[on]]
            grid[start + k, k] = self.piece[node]
        grid = grid.reshape(len(words), size, span)
        first = grid[:, :, 0]
        first[first == self.none] = self.unknown
        return grid


def forward(grid: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[end][word, language], each end scaled to a largest language of 1, and the logs of the scales."""
    words, size, span = grid.shape
    alpha, logs = np.zeros((size + 1, words, p.shape[1])), np.zeros((size + 1, words))
    alpha[0] = 1.0
    for e in range(1, size + 1):
        m = min(e, span)  # pieces of m letters to one, from the ends before
        scale = np.exp(logs[e - m : e] - logs[e - 1])
        here = p[grid[:, e - 1, m - 1 :: -1] if m < span else grid[:, e - 1, ::-1]].transpose(1, 0, 2)
        alpha[e] = (alpha[e - m : e] * here * scale[:, :, None]).sum(axis=0)
        top = alpha[e].max(axis=1)
        alpha[e] /= top[:, None]
        logs[e] = logs[e - 1] + np.log(top)
    return alpha, logs


def by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length at a time, at most so many letters together."""
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for size, some in groups.items():
        step = max(1, 100_000 // size)
        for i in range(0, len(some), step):
            yield some[i : i + step]


def expected(pieces: Pieces, p: np.ndarray, language: int, words: Counter) -> np.ndarray:
    """Expected uses of each piece in one language over all segmentations of the counted words."""
    q = p[:, language : language + 1]
    uses = np.zeros(len(p))
    for some in by_length(list(words)):
        grid = pieces.grid(some)
        n = np.array([words[w] for w in some], dtype=np.float64)
        size, span = grid.shape[1:]
        alpha, logs = forward(grid, q)
        # From the end: beta in the scale of alpha, so that alpha * piece * beta are posteriors.
        beta = np.zeros((size + 1, len(some)))
        beta[size] = 1.0
        for e in range(size, 0, -1):
            for k in range(1, min(e, span) + 1):
                ids = grid[:, e - 1, k - 1]
                step = q[ids, 0] * np.exp(logs[e - k] - logs[e])
                beta[e - k] += step * beta[e]
                np.add.at(uses, ids, n * alpha[e - k][:, 0] * step * beta[e] / alpha[size][:, 0])
    return uses


class LanguageModel:
    def __init__(self, path: str, languages: list[str], p: np.ndarray, share: np.ndarray):
        self.path, self.languages, self.p, self.share = path, languages, p, share

    def __getstate__(self):
        return self.path, self.languages, self.p, self.share

    def __setstate__(self, state):
        self.path, self.languages, self.p, self.share = state
        self.pieces, self.row, self.logs = pieces(self.path), {}, np.zeros((MEMORY, len(self.languages)))

    def learn(self, words: list[str]) -> None:
        if len(self.row) + len(words) > MEMORY:
            self.row.clear()
        if len(words) > len(self.logs):
            self.logs = np.zeros((len(words), len(self.languages)))
        for some in by_length(words):
            alpha, logs = forward(self.pieces.grid(["▁" + w for w in some]), self.p)
            at = len(self.row)
            self.logs[at : at + len(some)] = np.log(np.maximum(alpha[-1], 1e-300)) + logs[-1][:, None]
            self.row.update(zip(some, range(at, at + len(some))))

    def predict(self, some: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(some), [0.0] * len(some)
        found = [words_of(t) for t in some]
        met = set().union(*found)
        new = [w for w in met if w not in self.row]
        if len(self.row) + len(new) > MEMORY:
            self.row.clear()
            new = list(met)
        if new:
            self.learn(new)
        names, scores = [], []
        for words in found:
            if not words:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.logs[list(map(self.row.__getitem__, words))].sum(axis=0) + np.log(self.share)
            post = np.exp(total - total.max())
            names.append(self.languages[int(post.argmax())])
            scores.append(float(post.max() / post.sum()))
        return names, scores


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def fit(docs: DataFrame, path: str, bound: int = BOUND) -> LanguageModel:
    """Expected uses are summed by Spark; a row per piece and language reaches the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = materialize(rows.join(F.broadcast(ids.distinct()), "doc_id"), "sample-lang").repartition("doc_id")
    counts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel(path, [], np.zeros((0, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}
    have = pieces(path)
    size = have.none + 1
    start = np.array([0.5 ** len(x) for x in have.number], dtype=np.float64)
    p = np.zeros((size, len(languages)))
    p[: have.unknown] = (start / start.sum())[:, None]
    p[have.unknown] = UNKNOWN
    for _ in range(ROUNDS):
        now = p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, words = pieces(path), [Counter() for _ in languages]
            for batch in batches:
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words[number[lang]].update("▁" + w for w in words_of(text))
            for i, counted in enumerate(words):
                uses = expected(have, now, i, counted)
                at = np.flatnonzero(uses[: have.unknown] > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(uses[at])], names=["lang", "piece", "n"])

        got = sample.select("text", "lang").mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        uses = np.zeros((have.unknown, len(languages)))
        for r in got:
            uses[r["piece"], r["lang"]] = round(r["n"], 6)
        p = np.zeros((size, len(languages)))
        p[: have.unknown] = (uses + PRIOR) / (uses + PRIOR).sum(axis=0)
        p[have.unknown] = UNKNOWN
    share = np.array([counts[x] for x in languages], dtype=np.float64)
    return LanguageModel(path, languages, p, share / share.sum())


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = m.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return texts(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
