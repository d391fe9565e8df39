import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op11_line_dedup import LEAST_CHARS, LEAST_DOCS, Runs, deduplicate_lines, dropped_lines, keep_bitmaps

SPACE = re.compile(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows):
    """Kept texts by the rule alone."""
    number = lambda i: -(2**63) if i is None else i
    key = lambda line: SPACE.sub("", line).translate(LOWER)
    of = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= LEAST_CHARS:
                of[key(line)].add(number(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(of[key(x)]) < LEAST_DOCS or max(of[key(x)]) == number(i)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def odd_rows():
    rng = random.Random(5)
    common = ["This line of forty characters stands in many.", "ÄÖ" * 20, "ÄÖ" * 19 + "a", "x" * 39, "A rarer line, but it is long enough for a key"]
    rows = [(i, t) for i, t, _ in texts()]
    for i in range(100, 160):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line of document {i} with enough letters {j}" for j in range(rng.randint(1, 9))]
        lines = [rng.choice(["", " ", "\t\x0b", " "]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \x0c"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(200, "\n".join(common[:1] * 300)), (201, "\n"), (202, common[0] + "\n"), (None, common[0]), (159, common[0]), (160, common[1] + "\n" + common[1])]
    return rows + [(r, common[4]) for r in (300, 300, 301, 302, 303)]


def test_kept_texts_equal_the_rule(spark):
    rows = odd_rows()
    got = deduplicate_lines(documents(spark, [(i, t, "a") for i, t in rows]).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)
    assert any(r["n_dropped"] for r in got)


def test_bitmaps_tell_the_lines(spark):
    rows = odd_rows()
    want = {(i, len((t or "").split("\n"))) for i, t in rows}
    for r in keep_bitmaps(documents(spark, [(i, t, "a") for i, t in rows])).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8))
        assert bits[: r["n_lines"]].sum() == r["n_lines"] - r["n_dropped"] and not bits[r["n_lines"] :].any()
        assert (None if r["id"] == -(2**63) else r["id"], r["n_lines"]) in want


def test_runs_over_any_cuts_are_settled_alike():
    rng = random.Random(11)
    for _ in range(300):
        rows = sorted(((rng.randint(0, 4), 0, -rng.randint(0, 9), rng.randint(0, 5)) for _ in range(rng.randint(1, 60))))
        docs = defaultdict(set)
        for h, _, i, _ in rows:
            docs[h].add(-i)
        want = Counter((-i, p) for h, _, i, p in rows if len(docs[h]) >= 5 and -i != max(docs[h]))
        told = []
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 4))))
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            runs, task = Runs(5), rows[a:b]
            size = rng.randint(1, 9)
            for k in range(0, len(task), size):
                part = np.asarray(task[k : k + size])
                runs.batch(part[:, 0], part[:, 1], -part[:, 2], np.zeros(len(part), np.int64), part[:, 3].astype(np.int32))
            runs.end()
            told += runs.take().to_pylist()
        edges = defaultdict(set)
        for r in told:
            if r["edge"]:
                edges[r["hi"]].add(r["id"])
        got = Counter()
        for r in told:
            if not r["edge"] and (r["hi"] is None or len(edges[r["hi"]]) >= 5 and r["id"] != max(edges[r["hi"]])):
                got[r["id"], r["pos"]] += 1
        assert got == want


def test_one_digest_over_many_tasks(spark):
    rows = [(7, 1, i, 0, 0) for i in range(5_000)] + [(8, i, i, 0, 1) for i in range(500)] + [(9, 1, i, 0, 2) for i in range(4)]
    got = dropped_lines(spark.createDataFrame(rows, "hi long, lo long, id long, t long, pos int").repartition(6))
    assert {r["id"] for r in got.collect()} == set(range(4_999)) and got.count() == 4_999


def test_no_rows(spark):
    assert deduplicate_lines(nothing(spark)).collect() == []


def test_digest_of_an_emptied_text(spark):
    line = "one line of a certain length that all have got"
    got = {r["doc_id"]: r["text"] for r in deduplicate_lines(documents(spark, [(i, line, "a") for i in range(6)])).collect()}
    assert got == {**{i: "" for i in range(5)}, 5: line}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
