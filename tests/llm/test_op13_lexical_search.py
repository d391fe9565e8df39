import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm import op13_lexical_search as op
from vellum.llm.op13_lexical_search import Best, Block, batches_of, first_blocks, lexical_search, max_trees, raw_blocks, terms_of, totals

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(docs, items, k):
    """item -> [(doc_id, score)] by the rule alone."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for item, terms in asked.items():
        scored = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((i, score))
        scored.sort(key=lambda r: (-r[1], -math.inf if r[0] is None else r[0]))
        if scored:
            out[item] = scored[:k]
    return out


def odd_rows(n=500):
    rng = random.Random(8)
    pool = ["Alpha", "beta", "GAMMA", "delta9", "ÄÖ", "ſ", "x", "y2", "zeta", "eta", "theta", "iota", "kappa"]
    rows = [(i, t) for i, t, _ in texts()]
    rows += [(1_000 + i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    rows += [(5_000 + i, "rare Alpha beta") for i in range(80)] + [(None, "rare Alpha beta"), (5_000, "rare")]
    items = [(1, "alpha BETA rare"), (2, "gamma, gamma; (delta9)"), (3, None), (4, ""), (5, "unseen words only"), (6, "ÄÖ ſ é x"), (None, "iota"), (7, "kappa"), (7, "theta y2"), (8, "no id at all in this row but some words"), (9, "  !? ")]
    return rows, items + [(20 + i, " ".join(rng.choice(pool) for _ in range(6))) for i in range(12)]


def frames(spark, rows, items):
    return documents(spark, [(i, t, "a") for i, t in rows]).repartition(3), spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")


def listed(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        assert r["rank"] == len(out[r["item_id"]]) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return dict(out)


@pytest.mark.parametrize(("k", "block", "most"), [(50, 64, 1 << 20), (7, 100, 40), (1, 2048, 1 << 20)])
def test_hits_equal_the_rule(spark, k, block, most):
    rows, items = odd_rows()
    docs, asked = frames(spark, rows, items)
    assert listed(lexical_search(docs, asked, k, block, most)) == plain(rows, items, k)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x250)] + [" ", "\U0001f600", "ſ", "K"]
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(50))
        assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


def test_bounds_hold_and_ranges_below_the_score_stay_closed(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["filler"] * 5 + (["needle"] * 3 if i in (900, 901) else []) + ["hay"] * rng.randint(0, 2))) for i in range(2_000)]
    items = [(1, "needle hay")]
    docs, asked_rows = frames(spark, rows, items)
    (asked,) = batches_of(asked_rows)
    raw = raw_blocks(docs.coalesce(1).orderBy("doc_id"), asked.vocabulary)
    n, total, df = totals(raw, len(asked.vocabulary))
    asked.weigh(n, df)
    index = max_trees(raw, n, total)
    opened = []
    for row in index.collect():
        block, best = Block(row.asDict()), Best(2)
        add = best.add
        best.add = lambda s, i: (opened.append(len(s)), add(s, i))
        assert block.bounds(asked)[0] >= block.impacts.max()
        block.search(asked.terms, asked.weights, best)
    assert set(best.ids.tolist()) == {900, 901} and len(opened) < 10  # of over 40 leaves
    assert {r["block"] for r in first_blocks(index, asked).collect()} <= {r["block"] for r in index.select("block").collect()}


def test_equal_scores_go_by_id_over_blocks(spark):
    rows = [(i, "same words") for i in range(1_000, 0, -1)] + [(2_000, "other")]
    docs, items = frames(spark, rows, [(1, "same")])
    got = listed(lexical_search(docs, items, 50, 64))
    assert [i for i, _ in got[1]] == list(range(1, 51)) and len({s for _, s in got[1]}) == 1


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert lexical_search(nothing(spark), items).collect() == []
    assert lexical_search(documents(spark), items.where("false")).collect() == []
    assert lexical_search(documents(spark, [(1, "", "a")]), items).collect() == []
    assert np.iinfo(np.int64).min == op.NO_ID
