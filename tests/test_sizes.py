"""What queries hold and write as tables grow."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import search
from vellum.operators.keyword_index import postings_of
from vellum.plans import catalog, model
from vellum.shared import small_batches


def tables(spark, folder):
    docs = [(1, "one two two", "en"), (1, "two three", "en"), (2, "two", "de"), (3, None, "de")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("src1"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_terms_are_counted_without_an_index(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path)
    monkeypatch.setattr(model, "keyword_index", None)
    got = {r["term"]: (r["n"], r["df"]) for r in catalog.QUERIES["tokens_df"](spark, str(tmp_path)).collect()}
    # path "note-0.md" of four rows; ids 1 (twice), 2 and 3
    assert got == {"one": (1, 1), "two": (4, 2), "three": (1, 1), "note": (4, 3), "0": (4, 3), "md": (4, 3), "en": (2, 1), "de": (2, 2)}


def test_searches_write_the_postings_they_ask_for(spark, tmp_path):
    tables(spark, tmp_path)
    chunks = model.chunks(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "two three-one"), (2, "two absent")], "qid long, query string")
    whole, some = postings_of(chunks), search.postings_asked(asked, chunks)
    assert sorted(map(str, some.sizes.collect())) == sorted(map(str, whole.sizes.collect()))
    want = whole.rows.where("term in ('one', 'two', 'three')").withColumn("gaps", F.expr("CASE WHEN term <> 'two' THEN gaps END"))
    assert sorted(map(str, some.rows.collect())) == sorted(map(str, want.select(some.rows.columns).collect()))


@pytest.mark.parametrize("name", ["bm25_topk", "keyword_interleave", "keyword_only_degrade"])
def test_searches_write_no_index(spark, tmp_path, monkeypatch, name):
    tables(spark, tmp_path)
    spark.createDataFrame([(1, "two three"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(model, "keyword_index", None)
    assert {r["qid"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == {1}


@pytest.mark.parametrize("name", ["chunk_stats", "find_in_note", "wikilinks"])
def test_whole_texts_reach_python_in_small_batches(spark, tmp_path, name):
    tables(spark, tmp_path)
    settings = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in settings}
    try:
        small_batches(spark)
        small = {k: spark.conf.get(k) for k in settings}
        for k in settings:
            spark.conf.unset(k)
        catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert {k: spark.conf.get(k) for k in settings} == small
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
