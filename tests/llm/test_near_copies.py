import random

import numpy as np

from tests.llm.fixtures import documents
from vellum.llm import near_copies
from vellum.llm.op09_simhash import fingerprint, keep_one


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(60)]
    for i in range(60):  # from 1 replaced word to 12: similarity about 0.97 to 0.65
        texts += [edited(rng, texts[i], 1 + i % 12), edited(rng, texts[i], 1 + (i + 5) % 12)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    rows = list(enumerate(texts))
    kept = {r["doc_id"] for r in keep_one(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert kept == {min(i for i in range(len(texts)) if label[i] == x) for x in set(label)}
    assert 60 < len(kept) < 150


def test_large_key_is_dealt_whole(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TOKENS", 2000)
    rng = random.Random(4)
    base = " ".join(f"b{i}" for i in range(200))
    rows = [(i, edited(rng, base, 1), "a") for i in range(80)]
    assert [r["doc_id"] for r in keep_one(documents(spark, rows)).collect()] == [0]


def test_miss_rate_at_the_limit():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(3000):
        s = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = s[:270], np.r_[s[:240], s[270:]]  # 240 shared of 300: 0.8
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed == 0


def test_fingerprints_bring_copies_together(spark, monkeypatch):
    """Without a shared minimum, texts that op9's fingerprints link still meet, and their whole sets decide."""
    monkeypatch.setattr(near_copies, "band_keys", lambda s: np.arange(near_copies.BANDS) ^ near_copies.digest(s))
    rng = random.Random(6)
    texts = [" ".join(f"b{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(12)]
    texts += [edited(rng, t, 1 + i % 3) for i, t in enumerate(texts)]
    body = " ".join(f"c{i}" for i in range(400))
    texts += [" ".join([*[body] * 12, *(f"{x}{i}" for i in range(200))]) for x in "de"]
    fps = [fingerprint(t) for t in texts]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    far = {(i, j) for i, j in close if jaccard(texts[i], texts[j]) < 0.8}
    assert (25, 24) in far and len(close - far) >= 10  # similar fingerprints, half of the shingles
    label = list(range(len(texts)))
    for i, j in sorted(close - far):
        label = [label[j] if x == label[i] else x for x in label]
    kept = [r["doc_id"] for r in keep_one(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()]
    assert sorted(kept) == sorted(set(label))
