import random
import re
from collections import Counter
from itertools import permutations

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op12_filter_audit import Copies, audit, failure_masks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    """Letters that each row fails, by the rule alone; rows are (doc_id, text, part)."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = "A" if len(w) < 200 else ""
        fails += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else ""
        out.append(fails)
    return out


def plain_audit(rows, labels):
    fails, out = plain_fails(rows), {}
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                redundant = sum(letter in f for _, f in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == letter for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def odd_rows():
    rng = random.Random(3)
    rows = list(texts())
    pool = ["word " * 300, "Own Words Here " * 70, "a b c\x0bd\x85e\xa0f # " * 60, "", None, "ÄÖÜ " * 250, "X" * 10, " ".join(str(n) for n in range(250)), " ".join(f"V{n}" for n in range(205)) + " |"]
    for i in range(100, 220):
        rows.append((rng.choice([i, i, i, None, 100]), rng.choice(pool), rng.choice(["a", "b", "c", None, ""])))
    return rows


def test_audit_equals_the_rule(spark):
    rows, rng = odd_rows(), random.Random(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    labels = [x for x in labels if x[0] is not None] + [(9_999, 1, 1)]
    got = audit(documents(spark, rows).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == plain_audit(rows, labels)


def test_copies_over_any_cuts(spark):
    """One fingerprint for two texts, cut anywhere by fingerprint and doc_id, as range partitions are."""
    rng = random.Random(9)
    for _ in range(300):
        rows = sorted(((rng.randint(0, 2), rng.randint(0, 8), rng.choice([b"x", b"y"])) for _ in range(rng.randint(1, 40))), key=lambda r: r[:2])
        want = sorted((fp, t, i, any(f == fp and u == t and j < i for f, j, u in rows)) for fp, i, t in rows)
        places = [k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2]]
        cuts = sorted(rng.sample(places, min(len(places), rng.randint(0, 3))))
        told, ends = [], {}
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            copies = Copies()
            for fp, i, t in sorted(rows[a:b], key=lambda r: (r[0], r[2], r[1])):
                _, copy = copies.row(fp, t, i)
                told.append((fp, t, i, copy, copies.mark() if copies.open else None))
            for fp, digest, least in copies.last():
                ends[fp, digest] = min(least, ends.get((fp, digest), least))
        got = sorted((fp, t, i, copy or mark is not None and ends.get((fp, mark), i) < i) for fp, t, i, copy, mark in told)
        assert got == want


def test_a_third_of_the_rows_is_one_text(spark):
    rows = [(i, "the same text for a third" if i % 3 == 0 else f"text {i}", "a") for i in range(3_000)]
    got = Counter(r["mask"] & 16 for r in failure_masks(documents(spark, rows).repartition(8)).collect())
    assert got == {16: 999, 0: 2_001}


def test_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(nothing(spark), labels).collect() == []
    got = audit(documents(spark, [(1, "one", "a")]), labels).collect()
    assert len(got) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)
