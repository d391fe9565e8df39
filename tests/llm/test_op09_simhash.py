import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm import op09_simhash
from vellum.llm.components import components
from vellum.llm.op09_simhash import forest, keep_one, links, masks, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_against_brute_force(spark):
    rows = texts()
    got = near_duplicates(documents(spark)).collect()
    fp = [plain(t) for _, t, _ in rows]
    root = roots(sorted(set(fp)))
    least = {}
    for (i, _, _), f in zip(rows, fp):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f, least.get(root[f])) for (i, _, _), f in zip(rows, fp))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert near_duplicates(nothing(spark)).collect() == []


@pytest.mark.parametrize("sub", [16, 2048])
def test_links_lose_nothing(spark, monkeypatch, sub):
    monkeypatch.setattr(op09_simhash, "SUB", sub)
    rng = random.Random(sub)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)}
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    edges = links(rows)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)) >= 0 for r in edges.collect())
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(edges).collect()}
    want = roots(fps)
    groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    assert groups({f: found.get(f, f) for f in fps}) == groups(want)


def test_forest_spans_large_groups():
    rng = np.random.default_rng(3)
    fp = np.concatenate([rng.integers(0, 1 << 64, 700, dtype=np.uint64), np.uint64(12345) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))])
    a, b = forest(np.zeros(len(fp), np.int64), fp)
    assert len(a) == 59 and {*a.tolist(), *b.tolist()} == set(fp[700:].tolist())


def test_masks_meet():
    rng = random.Random(8)
    for n in (10, 1 << 25, 1 << 31):
        kept = masks(n)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in kept)


def test_long_chains(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (201, 200), (300, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def test_one_of_each_stays(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and not {40, 41, 42, 43, 44} & set(ids) and sum(50 <= (i or 0) < 56 for i in ids) == 1
    assert ids.count(80) == 1 and ids.count(None) == 1
    assert keep_one(nothing(spark)).collect() == []
