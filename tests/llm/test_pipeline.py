import random
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, nothing, texts, words
from vellum.llm.common import materialize


def planted(spark, folder):
    rng = random.Random(11)
    rows = [(i, "\n".join(words(rng, 12) + "." for _ in range(8)), "a") for i in range(300)]
    shared = " ".join(f"shared{i}" for i in range(60)) + "."
    rows += [(300 + i, words(rng, 30) + ".\n" + shared + "\n" + words(rng, 30) + ".", "a") for i in range(10)]
    rows += [(400 + i, rows[i][1], "a") for i in range(20)]
    rows += [(500 + i, words(rng, 60) + " vileword vilething" * 3, "a") for i in range(60)]
    rows += [(600 + i, " ".join("$$$%%%###" for _ in range(60)), "a") for i in range(60)]
    marks = [(i, int(not 600 <= i < 660), int(500 <= i < 560)) for i, _, _ in rows]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {i for i, _, _ in rows}
    assert set(left["quality"]) == {i for i in ids if i < 600}
    assert set(left["toxicity"]) == {i for i in ids if i < 500}
    assert set(left["near_duplicates"]) == {i for i in ids if i < 400}
    found = left["repeated_passages"]
    assert sum("shared5 shared6" in t for t in found.values()) == 1 and "shared5" in found[300]
    clean = dict((i, t) for i, t, _ in rows if i < 300)
    assert all(found[i] == t for i, t in clean.items())
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(found)
    whole = defaultdict(int)
    for r in packed:
        whole[r["sequence_id"]] += r["length"]
    assert max(whole.values()) <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda t: sorted(map(str, t.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(again) == key(docs.select(F.col("*")))


def counted(rows):
    out = defaultdict(int)
    for r in rows:
        out[tuple(map(str, r))] += 1
    return out


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, no rows."""
    planted(spark, tmp_path)
    odd = documents(spark, [*texts(), (None, None, None), (None, None, None), (700, None, "a"), (701, "", "a"), (702, "", "b"), (703, "y" * 60_000, "b")])
    for frame in (odd, nothing(spark)):
        docs, columns = frame, frame.columns
        for name, stage in corpus_pipeline.STAGES:
            before = counted(docs.drop("text", "n_chars").collect())
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                docs = materialize(docs, f"odd-{name}")
                assert docs.columns == columns
                after = counted(docs.drop("text", "n_chars").collect())
                assert all(n <= before[r] for r, n in after.items()), name  # rows go or stay as they are, but for their texts
        packed = docs.collect()
        assert bool(packed) == bool(after) and {r["doc_id"] for r in packed} == {None if "None" == r[0] else int(r[0]) for r in after}
