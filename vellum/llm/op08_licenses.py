"""Licence scan with a positional index of rare licence words.

Templates are licence notices and short licence texts. Their words get document frequencies over the
whole corpus (a fixed vocabulary, so the counts stay small). The index holds, of each template, the
places of its words of highest IDF, as many as weigh more than a match may lack: a notice that counts
shares one of them. A file's words that are in the index, highest IDF first, give the places where a
template could start; postings of one template that agree on a place are one candidate. A candidate
counts if the words that stand where the template has them, SLACK words around, weigh at least
COVERAGE of its IDF, and if its mandatory key phrase stands there word for word. Base phrases are
matched word for word.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; equal rows
give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import small_batches, table, texts

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, notice or licence text, mandatory key phrase.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache", "licensed under the apache license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "must retain the above copyright notice this list of conditions"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("eupl", "licensed under the european union public licence eupl", "european union public licence"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications and to alter it and redistribute it freely"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    *((label, f"spdx license identifier {name}", f"spdx license identifier {name}") for label, name in (
        ("isc", "isc"), ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 1"),
        ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("eupl", "eupl 1 2"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("cc0", "cc0 1 0"),
    )),
]
#: A template counts from this share of its IDF; words that may stand so many places off.
COVERAGE, SLACK = 0.6, 3

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


class LicenseIndex:
    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, base=BASE):
        self.idf = idf
        self.templates = [(label, notice.encode().split(), key.encode().split()) for label, notice, key in templates]
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.total = [sum(idf[w] for w in notice) or 1.0 for _, notice, _ in self.templates]
        # Of each template its rarest places, until the others can't make up the coverage by themselves.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, notice, _) in enumerate(self.templates):
            lack = (1 - COVERAGE) * self.total[t] + 1e-9
            for q in sorted(range(len(notice)), key=lambda q: (-idf[notice[q]], q)):
                self.postings[notice[q]].append((t, q))
                lack -= idf[notice[q]]
                if lack < 0:
                    break
        self.base_words = {w for p, _ in self.base for w in p}

    def covered(self, t: int, start: int, words: list[bytes]) -> float:
        """Share of the template's IDF that stands within SLACK words of its place, for a template that starts there."""
        got = 0.0
        for q, w in enumerate(self.templates[t][1]):
            lo = max(start + q - SLACK, 0)
            if w in words[lo : max(start + q + SLACK + 1, 0)]:
                got += self.idf[w]
        return got / self.total[t]

    def holds_key(self, t: int, start: int, words: list[bytes]) -> bool:
        _, notice, key = self.templates[t]
        lo, hi = max(start - SLACK, 0), min(start + len(notice) + SLACK, len(words)) - len(key)
        return any(words[i] == key[0] and words[i : i + len(key)] == key for i in range(lo, hi + 1))

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        """Base places, their least and greatest start, base labels, all labels, score."""
        met = set(words)
        rare, based = met.intersection(self.postings), met.intersection(self.base_words)
        if not rare and not based:
            return 0, None, None, "", "", 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in rare or w in based:
                at[w].append(i)

        def starts(phrase: list[bytes]) -> set[int]:
            return set.intersection(*({p - q for p in at.get(w, ())} for q, w in enumerate(phrase)))

        found = [(p, label) for phrase, label in self.base for p in starts(phrase)]
        base = {label for _, label in found}
        labels, score = set(base), 1.0 if base else 0.0
        tried: set[tuple[int, int]] = set()
        for w in sorted(rare, key=lambda w: (-self.idf[w], w)):
            for t, q in self.postings[w]:
                for p in at[w]:
                    for start in range(p - q - SLACK, p - q + SLACK + 1):
                        if (t, start) in tried:
                            continue
                        tried.add((t, start))
                        if self.holds_key(t, start, words) and (share := self.covered(t, start, words)) >= COVERAGE:
                            labels.add(self.templates[t][0])
                            score = max(score, share)
        places = [p for p, _ in found]
        return len(found), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(score, 1.0)


def corpus_idf(docs: DataFrame, templates=TEMPLATES, base=BASE) -> dict[bytes, float]:
    """IDF of the templates' and base phrases' words over all documents; a row per such word reaches the driver."""
    vocabulary = {w for _, notice, key in templates for w in (notice + " " + key).encode().split()} | {w for p in base for w in p.encode().split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                df.update(vocabulary.intersection(words_of(text)))
                df[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    counts = {bytes(r["word"]): r["n"] for r in texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(b"", 0)
    return {w: math.log(1 + (n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    idf = corpus_idf(docs, templates, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(idf, templates, base)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                rows.append((len(words), *index.scan(words)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts(docs).mapInArrow(run, SCANNED)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
