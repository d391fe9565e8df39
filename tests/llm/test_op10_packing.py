import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op10_packing import cut, dominated_pairs, encoder, pack, pack_histogram

PATH = public_tokenizers.path("byte_bpe_50k.json")


def least_bins(items, capacity):
    """Fewest bins, by trying subsets for the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(len(rest) + 1):
        for some in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in some) <= capacity:
                best = min(best, 1 + least_bins([x for i, x in enumerate(rest) if i not in some], capacity))
    return best


def test_dominated_bins_are_in_an_optimum():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(7)), reverse=True)
        left = [0] * (capacity + 1)
        for x in items:
            left[x] += 1
        fixed = sum(n for _, n in dominated_pairs(left, capacity))
        rest = [x for x in range(capacity, 0, -1) for _ in range(left[x])]
        assert fixed + least_bins(rest, capacity) == least_bins(items, capacity)


def test_histograms_are_packed_whole():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([20, 50, 100])
        items = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        got, bins = Counter(), pack_histogram(items, capacity)
        for b, n in bins:
            assert n > 0 and sum(x * m for x, m in b) <= capacity
            for x, m in b:
                got[x] += m * n
        assert got == items
        assert sum(n for _, n in bins) <= 11 * -(-sum(x * n for x, n in items.items()) // capacity) // 9 + 2


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and cut(20, 10) == [(0, 10), (10, 10)]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x340), 0x85, 0xA0, 0x2028, 0x3000, 0x1F600, 0xAC00]]
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a  b\n\n c", "<|endoftext|>x", "", "ab" * 20_000, " " * 9_000 + "x"]
    for t in some + [t for _, t, _ in texts() if t]:
        assert np.frombuffer(encoder(PATH).encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_query_rows(spark):
    library = Tokenizer.from_file(PATH)
    got = pack(documents(spark), PATH).collect()
    want = Counter()
    for i, t, _ in texts():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(cut(len(ids), 2048)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert pack(nothing(spark), PATH).collect() == []
