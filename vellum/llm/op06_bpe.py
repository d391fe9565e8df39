"""BPE encoding by a bounded-lookahead transducer, and incremental decoding.

A merge can reach to the right only through merges of falling rank, each starting in the right
edge of the one before; the longest such chain of the merge list, in symbols, is a sufficient
lookahead: a token that ends so many symbols before the end of what has been read can't change.
The transducer therefore keeps one block and the lookahead, emits stable tokens and goes on from
their end. Decoding turns token bytes into text with a UTF-8 state machine that holds at most an
unfinished character.

Defined cases: a null or empty text has no tokens (both digests are of the empty string); equal
rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import byte_letters, small_batches, table, texts

BLOCK = 512
#: Chunks and pieces that a worker remembers, in each of two generations.
MEMORY = 75_000
#: Chunks whose digests are fed at a time.
FEED = 8192


class Memory(dict):
    """What make(key) gave, remembered for up to twice limit keys: the current ones and the generation before."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteToText:
    """Incremental UTF-8 decoder: push bytes, get the text that is complete."""

    def __init__(self, errors: str = "replace"):
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def push(self, some: bytes) -> str:
        return self.machine.decode(some)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Transducer:
    """Streaming BPE for a tokenizer file with a word-end suffix."""

    def __init__(self, path: str, block: int = BLOCK, memory: int = MEMORY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t))
        self.block = block
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The tokenizer's white space has no information separators (U+001C to U+001F).
        self.blank = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.piece = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Memory(self.learn_piece, memory)
        self.known = Memory(self.learn, memory)

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a whole symbol sequence: lowest rank first, leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        get = self.ranks.get
        if n <= 48:
            none = len(self.ranks)
            tokens = list(symbols)
            ranks = [get(p, none) for p in zip(tokens, tokens[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((tokens[i - 1], tokens[i]), none)
                if i < len(ranks):
                    ranks[i] = get((tokens[i], tokens[i + 1]), none)
            return tokens
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get((token[x], token[y]))) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return [t for t in token if t]

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a word, emitted once stable; holds block + lookahead symbols."""
        held: list[str] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= self.block + self.lookahead:
                done = 0
                for token in self.merge(held):
                    size = len(token)
                    if done + size > len(held) - self.lookahead:
                        break
                    yield token
                    done += size
                held = held[done:]
        yield from self.merge(held)

    def symbols(self, piece: str) -> Iterator[str]:
        letters, last = self.letters, ""
        for b in piece.encode("utf-8"):
            if last:
                yield last
            last = letters[b]
        if last:
            yield last + self.suffix

    def normal(self, text: str) -> str:
        """NFC, then lower case of each character by itself (no final-sigma rule)."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def chunks(self, text: str) -> Iterator[list[str]]:
        """White-space chunks of a text, at most FEED at a time; special tokens are chunks."""
        for k, span in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
            if k % 2:
                yield [span]
                continue
            span = self.normal(span)
            parts = span.split() if not any(c in span for c in "\x1c\x1d\x1e\x1f") else [x for x in self.blank.split(span) if x]
            for i in range(0, len(parts), FEED):
                yield parts[i : i + FEED]

    def learn_piece(self, piece: str) -> tuple[str, str]:
        ids = [self.vocab[t] for t in self.transduce(self.symbols(piece))]
        return " ".join(map(str, ids)), "".join(self.decode(ids))

    def learn(self, chunk: str) -> tuple[str, str]:
        """The chunk's ids and decoded text, each joined by spaces."""
        if chunk in self.special:
            return str(self.special[chunk]), "".join(self.decode([self.special[chunk]]))
        found = [self.pieces[p] for p in self.piece.findall(chunk)]
        return found[0] if len(found) == 1 else (" ".join([x for x, _ in found]), " ".join([x for _, x in found]))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The library's text of ids: without a decoder in the file, token names joined by a space."""
        first = True
        for i in ids:
            yield self.names[i] if first else f" {self.names[i]}"
            first = False

    def plain(self, ids: Iterable[int]) -> Iterator[str]:
        """The bytes that ids stand for, as text; a word's end becomes a space."""
        machine = ByteToText()
        for i in ids:
            name = self.names[i]
            ends = bool(self.suffix) and name.endswith(self.suffix)
            raw = name.encode() if name in self.special else bytes(self.bytes[c] for c in (name.removesuffix(self.suffix) if ends else name))
            yield machine.push(raw + b" " * ends)
        yield machine.finish()

    def encode(self, text: str) -> Iterator[int]:
        for some in self.chunks(text):
            for chunk in some:
                if chunk in self.special:
                    yield self.special[chunk]
                else:
                    for p in self.piece.findall(chunk):
                        yield from (self.vocab[t] for t in self.transduce(self.symbols(p)))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the decoded text; fed block by block."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for some in self.chunks(text):
            if not some:
                continue
            found = list(map(self.known.__getitem__, some))
            said, gap = " ".join([x for x, _ in found]), " " if n else ""
            n += said.count(" ") + 1
            ids.update((gap + said).encode())
            back.update((gap + " ".join([x for _, x in found])).encode("utf-8"))
        return n, ids.hexdigest(), back.hexdigest()


def sufficient_lookahead(merges: list[tuple[str, str]], size) -> int:
    """Symbols to the right of a token's end that can still change it, from the merge list alone."""
    right: dict[str, set[str]] = {}
    reach: dict[str, int] = {}

    def edge(token: str) -> set[str]:
        """The token and all its right parts, however it was made."""
        found, todo = {token}, [token]
        while todo:
            for part in right.get(todo.pop(), ()):
                if part not in found:
                    found.add(part)
                    todo.append(part)
        return found

    most = 1
    for a, b in merges:  # by rising rank: what is known so far has lower rank
        beyond_a = max((reach.get(x, 0) for x in edge(a)), default=0)
        beyond_b = max((reach.get(x, 0) for x in edge(b)), default=0)
        here = max(size(b) + beyond_b, beyond_a)
        reach[a] = max(reach.get(a, 0), here)
        right.setdefault(a + b, set()).add(b)
        most = max(most, here)
    return most


_KNOWN: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _KNOWN:
        _KNOWN[path] = Transducer(path)
    return _KNOWN[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            ids = [list(t.encode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that a column of ids stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            back = ["".join(t.plain(x or [])).rstrip(" ") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            rows = [t.digests(x) for x in batch.column(1).to_pylist()]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
