import numpy as np
from pyspark.sql import functions as F

from vellum.llm import op05_ann
from vellum.llm.op05_ann import op5_ann, scan, search


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,j->i", x, x[i])
        s[ids == ids[i]] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if np.isfinite(s[j])][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x, more=()):
    rows = [(int(i), [float(v) for v in r], 1, 0.5) for i, r in zip(ids, x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, score double")


def test_recall_on_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_ann(spark, sf).toPandas()
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute(t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(np.float64))
    hits = sum(len({i for i, _ in want[q]} & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) > 0.9
    assert set(got.groupby("query_id").size()) == {20}
    exact = {(q, i): s for q, l in want.items() for i, s in l}
    assert all(np.isclose(exact[k], s, rtol=0, atol=1e-12) for k, s in zip(zip(got["query_id"], got["vec_id"]), got["score"]) if k in exact)


def test_lists_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(op05_ann, "BOUND", 256)
    monkeypatch.setattr(op05_ann, "BLOCK", 50)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:1200] = x[700]  # one vector in a third of the rows
    ids = np.arange(1500)
    rows = frame(spark, ids, x)
    got = search(rows, rows.where(F.col("vec_id") % 20 == 0)).toPandas()
    want = brute(ids, x.astype(np.float64))
    found = {q: list(zip(g.sort_values("rank")["vec_id"], g.sort_values("rank")["score"])) for q, g in got.groupby("query_id")}
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.9
    assert all(len(v) == 20 and v == sorted(v, key=lambda r: (-r[1], r[0])) for v in found.values())


def test_scan_without_doubt_is_exact_above_the_floor():
    rng = np.random.default_rng(9)
    q, x = rng.standard_normal((5, 40)), rng.standard_normal((300, 40))
    rotation = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    ids = np.arange(300)
    got = scan(q, np.arange(1000, 1005), np.full(5, -np.inf), x, ids, rotation)
    for i in range(5):
        assert list(got[1][got[0] == 1000 + i]) == list(np.lexsort((ids, -(q[i] @ x.T)))[:20])


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((30, 8)).astype(np.float32)
    nan = float("nan")
    odd = [(100, None, 1, 0.0), (120, [0.0] * 8, 1, 0.0), (140, [nan] * 8, 1, 0.0), (160, [1.0, None] + [1.0] * 6, 1, 0.0), (180, [float("inf")] * 8, 1, 0.0), (200, [1.0] * 3, 1, 0.0), (None, [1.0] * 8, 1, 0.0), (220, [], 1, 0.0)]
    rows = frame(spark, np.arange(30), x, odd)
    got = search(rows, rows.where(F.col("vec_id") % 20 == 0)).collect()
    assert {r["query_id"] for r in got} == {0, 20} and {r["vec_id"] for r in got} <= set(range(30))
    few = frame(spark, np.arange(5), x[:5])
    assert search(few, few.where("vec_id = 0")).count() == 4
    none = few.where("vec_id < 0")
    assert search(none, none).collect() == []
