import hashlib
import random
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op01_fingerprints import fingerprints
from vellum.llm.unicode_tables import canonical


def plain(text):
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).upper().lower().replace("ς", "σ"))
    return " ".join(text.split())


def expected():
    rows = sorted(((i, t or "") for i, t, _ in texts()), key=lambda r: (r[0] is None, r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((i, t, t[: len(t) - q] + following[:q], following))
    return out


def check(got):
    want = sorted((i if i is not None else -1, len(t), hashlib.sha256(e.encode()).hexdigest(), float(plain(t) == plain(e)), float(plain(t) == plain(f))) for i, t, e, f in expected())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want


def test_against_brute_force(spark):
    got = fingerprints(documents(spark)).collect()
    check(got)
    by = defaultdict(set)
    for r in got:
        by[r["fingerprint"]].add(r["doc_id"])
    assert {3, 40, 41, 42, 43, 44} in by.values() and {75, 76, 77} in by.values() and {70, 71, 72} in by.values()


def test_colliding_digests_are_told_apart(spark):
    got = fingerprints(documents(spark), lambda t: F.hex(F.char_length(t) % 3)).collect()
    check(got)
    same = defaultdict(set)
    for r, (_, t, e, _) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), expected()):
        if r["doc_id"] == 81:
            continue  # two texts under one id
        same[r["fingerprint"]].add(plain(t))
    assert all(len(x) == 1 for x in same.values())


def test_canonical_text(spark):
    some = ["q̣̇x", "ạ́", "ṩ ṩ", "Å Ω", "क़", "ΣΑΣ", "A  b\t\n"]
    got = spark.createDataFrame([(s,) for s in some], "t string").select(canonical(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [plain(s) for s in some]


def test_canonically_equal_texts_are_one(spark):
    rng = random.Random(1)
    greek, korean, indic = "ᾷἆΐᾳώ", "각힣가나닭", "ொோௌৌோෞೋൊ"
    some = [*greek, *korean, *indic, "\u1100\u1161\u11a8", "\u1161", "\uac00\u11a7", "\uac01\u11a8", "\u0bc6\u0301\u0bbe", "\u0301a", "e\u0323\u0301\u0302", "\u0344", "\u212b", "𑂚", "각\u0323\u11a8"]
    marks = ["\u0301", "\u0323", "\u0345", "\u0342", "\u0308", "\u0327", "\u093c"]
    some += [rng.choice("aeoαωυক가") + "".join(rng.sample(marks, rng.randint(1, 4))) + rng.choice(["", "x", "\u11a8"]) for _ in range(150)]
    rows = [(k, f) for k, s in enumerate(some) for f in {s, unicodedata.normalize("NFC", s), unicodedata.normalize("NFD", s)}]
    got = spark.createDataFrame(rows, "k int, t string").select("k", "t", canonical(F.col("t")).alias("c")).collect()
    assert [(r["k"], r["c"]) for r in got if r["c"] != plain(r["t"])] == []
    assert len({(r["k"], r["c"]) for r in got}) == len(some)


def test_empty_table(spark):
    assert fingerprints(nothing(spark)).collect() == []


def test_one_row_is_its_own_next(spark):
    r = fingerprints(documents(spark, [(5, "abcdefgh", "a")])).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
