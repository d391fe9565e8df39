import random
import re

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op08_licenses import BASE, COVERAGE, SLACK, TEMPLATES, corpus_idf, scan_licenses

SOME = [
    (1, "Some text. Licensed under the Apache License, Version 2.0.\nMore", "a"), (2, "Released under the MIT License. mit license", "a"),
    (3, "This work is licensed under the GNU General Public License, version 3", "a"), (4, "Licensed under CC BY-NC 4.0.", "b"),
    (5, "All rights reserved.", "b"), (6, "the license of my car, apache helicopters, cc the boss by mail", "b"), (7, "cc by cc by cc", "a"), (8, "É cc by", "a"),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_against_brute_force(spark):
    rows = SOME + [r for r in texts() if r[0] is not None and r[0] > 8 and r[0] not in (80, 81)]
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t or "")
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[1]["labels"] == "apache,apache-2.0" and got[4]["labels"] == "cc-by,cc-by-nc" and got[5]["labels"] == "all-rights-reserved"
    assert got[6]["labels"] == "" and got[6]["score"] == 0


def test_odd_rows(spark):
    docs = documents(spark)
    assert scan_licenses(docs).count() == docs.count()
    assert scan_licenses(nothing(spark)).collect() == []


def test_all_notices_at_once(spark):
    text = " and then ".join(notice for _, notice, _ in TEMPLATES)
    got = scan_licenses(documents(spark, [(1, text, "a"), *((2 + i, f"other words here {i}", "b") for i in range(20))])).collect()
    assert next(r["labels"] for r in got if r["doc_id"] == 1) == ",".join(sorted({label for label, _, _ in TEMPLATES}))


def brute_labels(text, idf):
    """Labels of all templates at every place of the text."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    labels = set(filter(None, brute(text)[4].split(",")))
    for label, notice, key in TEMPLATES:
        notice, key = notice.encode().split(), key.encode().split()
        total = sum(idf[w] for w in notice)
        for start in range(-len(notice) - SLACK, len(words) + SLACK + 1):
            near = words[max(start - SLACK, 0) : max(start + len(notice) + SLACK, 0)]
            if any(near[i : i + len(key)] == key for i in range(len(near))):
                got = sum(idf[w] for q, w in enumerate(notice) if w in words[max(start + q - SLACK, 0) : max(start + q + SLACK + 1, 0)])
                if got / total >= COVERAGE:
                    labels.add(label)
    return ",".join(sorted(labels))


def edited(rng, notice):
    words = notice.split()
    for _ in range(rng.randint(0, max(len(words) // 6, 1))):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["changed"], [words[i], "more"], [words[i].upper()]])
    return " ".join(words)


def test_labels_of_edited_notices_against_every_place(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(["the", "of", "and", "is", "house", "license", "software", "river"]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for k in range(rng.randint(0, 2)):
            parts.insert(k, edited(rng, rng.choice(TEMPLATES)[1]))
        rows.append((i, "\n".join(parts), "a"))
    rows += [(200, "SPDX-License-Identifier: ISC", "a"), (201, "Licensed under the European Union Public Licence (EUPL) 1.2", "a"), (202, "Redistribution and use in source and binary forms, with modification, are permitted", "a"), (203, "", "a")]
    docs = documents(spark, rows)
    idf = corpus_idf(docs)
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(docs).collect()}
    assert got == {i: brute_labels(t, idf) for i, t, _ in rows}
    assert (got[200], got[201], got[202]) == ("isc", "eupl", "bsd") and sum(map(bool, got.values())) > 40
    assert any("," in x for x in got.values())
