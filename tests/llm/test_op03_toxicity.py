import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.fixtures import documents, nothing, words
from vellum.llm import op03_toxicity
from vellum.llm.op03_toxicity import NearestExamples, fit, keep_accepted, label_weight, op3_toxicity, score_documents, words_of

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def entries(counts):
    at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    return at, np.array([t for c in counts for t in c], np.int64), np.array([n for c in counts for n in c.values()], np.float64)


def query(c):
    return np.array(list(c), np.int64), np.array(list(c.values()), np.float64)


def test_blocks_give_the_exact_neighbours():
    rng = random.Random(3)
    weight = np.array([rng.uniform(1, 5) for _ in range(60)])

    def some():  # low terms are frequent, high ones rare
        return {min(int(rng.expovariate(0.08)), 59): rng.randint(1, 4) for _ in range(rng.randint(1, 9))}

    counts = [some() for _ in range(501)]
    near = NearestExamples(weight, np.arange(501), np.arange(501) % 2, *entries(counts))
    assert 0 < near.frequent[1].shape[1] < 60

    def dense(c):
        v = np.zeros(60)
        for t, n in c.items():
            v[t] = (1 + math.log(n)) * weight[t]
        return v / np.linalg.norm(v)

    every = np.array([dense(c) for c in counts])
    asked = [some() for _ in range(150)] + counts[:20]
    without = [-1] * 150 + list(range(20))
    for q, skip, (cosine, rows) in zip(asked, without, near.nearest([query(c) for c in asked], without)):
        score = every @ dense(q)
        if skip >= 0:
            score[skip] = -1
        want = np.sort(score[score > 0])[::-1][: near.neighbours]
        assert np.allclose(cosine, want, rtol=0, atol=1e-12)
        assert np.allclose(score[near.ids[rows]], cosine, rtol=0, atol=1e-12)
        assert list(near.labels[rows]) == [i % 2 for i in near.ids[rows]]


def test_equal_examples_tie_and_queries_stand_alone():
    """To the last bit: copies of an example, and a query asked alone or with others, skipped blocks or none."""
    rng = random.Random(8)
    weight = np.array([rng.uniform(1, 5) for _ in range(3000)])
    some = lambda: {min(int(rng.expovariate(0.004)), 2999): rng.randint(1, 3) for _ in range(rng.randint(20, 120))}
    counts = [some() for _ in range(700)]
    counts += [counts[i] for i in rng.sample(range(700), 200)] + [{2990 + i % 10: 1, 2999: 1} for i in range(60)]
    order = rng.sample(range(len(counts)), len(counts))
    counts = [counts[i] for i in order]
    near = NearestExamples(weight, np.arange(len(counts)), np.arange(len(counts)) % 2, *entries(counts))
    asked = counts[:150] + [some() for _ in range(50)]
    together = near.nearest([query(c) for c in asked])
    for c, (cosine, rows) in zip(asked, together):
        alone = near.nearest([query(c)])[0]
        assert list(alone[0]) == list(cosine) and list(near.ids[alone[1]]) == list(near.ids[rows])
        found = {}
        for s, r in zip(cosine, rows):
            found.setdefault(tuple(sorted(counts[near.ids[r]].items())), set()).add(s)
        assert all(len(s) == 1 for s in found.values())


def test_long_lists_are_read_as_they_are_kept():
    """An entry costs the bytes of its example and count, not a weight of its own as well, which is most of what a search reads."""
    counts = [{(i * 7 + j * 13) % 100: 1 for j in range(4)} for i in range(2000)]
    near = NearestExamples(np.ones(100), np.arange(2000), np.arange(2000) % 2, *entries(counts))
    cosine, rows = near.nearest([query(counts[5])])[0]
    assert near.ids[rows[0]] == 5 and abs(cosine[0] - 1) < 1e-12 and near.frequent[1].shape[1] == 0
    parts = [x for v in near.__dict__.values() for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, np.ndarray) and len(x) == len(near.entries[0])]
    assert sum(x.nbytes for x in parts) < 8 * len(near.entries[0])


def plain(docs, marks):
    """doc_id: (share of votes, cosines) by dense vectors over all words."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in docs}
    text = dict(docs)
    held = sorted((i, y) for i, y in marks if fold[i])
    every = {i: Counter(words_of(t)) for i, t in docs}
    space = sorted({w for i, _ in held for w in every[i]})
    number = {w: k for k, w in enumerate(space)}
    df = Counter(w for c in every.values() for w in c)
    idf = np.array([math.log(1 + (len(docs) + 1) / (df[w] + 1)) for w in space])
    pos, neg = (np.array([sum(w in every[i] for i, y in held if y == k) for w in space], float) for k in (1, 0))
    weight = idf * label_weight(pos, neg, sum(y for _, y in held), sum(1 - y for _, y in held))

    def vector(i):
        v = np.zeros(len(space))
        for w, n in every[i].items():
            if w in number:
                v[number[w]] = (1 + math.log(n)) * weight[number[w]]
        return v / (np.linalg.norm(v) or 1)

    x, y = np.array([vector(i) for i, _ in held]), np.array([k for _, k in held], float)
    out = {}
    for i in text:
        s = x @ vector(i)
        best = [k for k in np.lexsort((np.arange(len(s)), -s)) if s[k] > 0][:15]
        w = s[best] ** 2 / np.maximum(1 - s[best] + 0.05, 0.05)
        out[i] = (w @ y[best] + 0.01 * y.mean()) / (w.sum() + 0.01), s[best]
    return out


def test_whole_query_against_dense_vectors(spark, monkeypatch):
    rng = random.Random(11)
    text = [(i, words(rng, rng.randint(1, 40)) + (" vileword" if i % 6 == 0 else "")) for i in range(300)]
    marks = [(i, int(i % 6 == 0)) for i in range(0, 300, 2)]
    docs, some = documents(spark, [(i, t, "a") for i, t in text]), labels(spark, [(i, 1, y, "") for i, y in marks])
    model = fit(docs, some)
    want = plain(text, marks)
    got = {r["doc_id"]: r for r in score_documents(docs, model).collect()}
    a, b = model.curve
    for i, (share, cosine) in want.items():
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-(a * share + b)))) < 1e-9
        assert [x.split(":")[1] for x in got[i]["evidence"].split(",") if x] == [f"{s:.3f}" for s in cosine[:3]]


def planted(n=400):
    rng = random.Random(5)
    rows = [(i, words(rng, 60) + (" vileword and vilething " * 2 if i % 8 == 0 else ""), "a") for i in range(n)]
    return rows, [(i, 1, int(i % 8 == 0), "clash") for i in range(n)]


def test_finds_planted_words_and_leaves_clean_documents(spark):
    rows, marks = planted()
    docs, some = documents(spark, rows), labels(spark, marks)
    got = {r["doc_id"]: r for r in score_documents(docs, fit(docs, some)).collect()}
    assert all(got[i]["predicted"] == y for i, _, y, _ in marks)
    assert got[0]["evidence"].split(",")[0].endswith(":1")
    assert keep_accepted(docs, some).count() == sum(1 - y for _, _, y, _ in marks)


def test_a_copy_of_an_example_with_words_of_its_own_is_found(spark):
    rows, marks = planted()
    own = " ".join(f"ownword{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    at = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5)
    docs = documents(spark, [*rows, (at, own, "a"), (2000, own, "b"), (2001, own + " more words here", "b")])
    got = {r["doc_id"]: r for r in score_documents(docs, fit(docs, labels(spark, [*marks, (at, 1, 1, "")]))).collect()}
    assert got[2000]["predicted"] == got[2001]["predicted"] == 1
    assert got[2000]["evidence"].startswith(f"{at}:1.000:1")


def test_held_out_accuracy_and_calibration(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    known = got.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.005
    assert abs(held["score"].mean() - held["toxic"].mean()) < 0.02
    assert ((held["score"] - held["toxic"]) ** 2).mean() < 0.02


def test_odd_rows(spark):
    docs = documents(spark)
    got = score_documents(docs, fit(docs, labels(spark, [(i, 1, i % 2, "") for i in range(40)] + [(None, 1, 0, ""), (2, 1, None, "")]))).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = labels(spark, [])
    assert {(r["score"], r["predicted"]) for r in score_documents(docs, fit(docs, none)).collect()} == {(0.5, 1)}
    assert keep_accepted(docs, none).count() == docs.count()
    same = labels(spark, [(i, 1, 0, "") for i in range(40)])
    assert len({r["score"] for r in score_documents(docs, fit(docs, same)).collect()}) == 1
    assert keep_accepted(docs, same).count() == docs.count()
    blank = labels(spark, [(70, 1, 0, ""), (71, 1, 1, ""), (72, 1, 0, ""), (78, 1, 1, "")])
    assert len(score_documents(docs, fit(docs, blank)).collect()) == docs.count()
    empty = nothing(spark)
    assert score_documents(empty, fit(empty, none)).collect() == []
