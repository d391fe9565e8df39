"""The store of chunks and its keyword index through index passes."""

import math
from collections import Counter

from pyspark.sql import functions as F

from vellum.operators import embedding, search
from vellum.operators.keyword_index import postings_of
from vellum.operators.note_store import NoteStore, sync_store


def disk(spark, notes):
    return spark.createDataFrame(list(notes.items()), "path string, body string").withColumn("doc_hash", F.sha2(F.col("body").cast("binary"), 256))


def hits(store, spark, query, posted=None):
    asked = spark.createDataFrame([(1, query)], "qid long, query string")
    rows = search.bm25(asked, posted or store.postings()).join(store.chunks().select("id", "path", "idx"), "id").collect()
    return {(r["path"], r["idx"]): round(r["score"], 9) for r in rows}


def test_the_keyword_index_follows_the_notes(spark, tmp_path):
    store, embed = NoteStore.create(spark, f"file://{tmp_path}/s"), embedding.hashing_embedder(8)

    def poisoned(some):
        if any("poison" in t for t in some):
            raise ValueError("bad text")
        return embed(some)

    notes = {f"n{i}.md": f"# Head {i}\nalpha {'beta ' * (i % 3)} word{i}\n# Second\ngamma{i} sync.once" for i in range(12)} | {"void.md": ""}
    first = sync_store(store, disk(spark, notes), embed)
    assert (first.indexed, first.skipped, first.pruned, first.failed, first.chunks, first.errors) == (13, 0, 0, 0, 24, None)
    assert store.chunks().select("id").distinct().count() == 24
    assert hits(store, spark, "beta sync.once") == hits(store, spark, "beta sync.once", postings_of(store.chunks())) and hits(store, spark, "beta")
    del notes["n1.md"]
    notes |= {"n2.md": "only beta now", "new.md": "beta beta", "n4.md": "poison beta"}
    second = sync_store(store, disk(spark, notes), poisoned)
    # the empty note is looked at each time
    assert (second.indexed, second.skipped, second.pruned, second.failed, second.chunks) == (3, 9, 1, 1, 2)
    assert second.errors.startswith("n4.md: ValueError")
    texts = Counter(r["path"] for r in store.chunks().collect())
    assert texts["n2.md"] == 1 and texts["n4.md"] == 2 and "n1.md" not in texts and texts["new.md"] == 1
    assert hits(store, spark, "beta sync.once") == hits(store, spark, "beta sync.once", postings_of(store.chunks()))
    assert ("n4.md", 0) in hits(store, spark, "alpha") and not any(p == "n1.md" for p, _ in hits(store, spark, "alpha"))
    store.delete(spark.createDataFrame([("new.md",)], "path string"))
    n = store.chunks().count()
    assert n == store.chunks().select("id").distinct().count() and "new.md" not in {r["path"] for r in store.paths().collect()}
    best = max(hits(store, spark, "beta").values())
    df = len(hits(store, spark, "beta"))
    assert best > 0 and math.isfinite(best) and df == store.chunks().where("text like '%beta%'").count()
