import zlib

import numpy as np

from tests.llm.fixtures import documents, nothing
from vellum.llm.op02_quality import AdditiveModel, fit, keep_accepted, op2_quality, score_documents

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 16))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel(x, y)
    assert (0, 1) in model.pairs
    assert (((model.score(x) > 0.5) == y).mean()) > 0.9


def test_held_out_accuracy(spark):
    got = op2_quality(spark, SF).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == got["predicted"]).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    known = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93


def test_odd_rows(spark):
    docs = documents(spark)
    some = labels(spark, [(i, i % 2, 0, "clash") for i in range(40)] + [(None, 1, 0, ""), (3, None, 1, "")])
    got = score_documents(docs, fit(docs, some)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = keep_accepted(docs, some)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] for r in got)


def test_without_labels_or_rows(spark):
    docs, none = documents(spark), labels(spark, [])
    assert {r["score"] for r in score_documents(docs, fit(docs, none)).collect()} == {0.5}
    empty = nothing(spark)
    assert score_documents(empty, fit(empty, none)).collect() == []
