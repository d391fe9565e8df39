import numpy as np

from vellum.llm.op05_ann import search


def test_repeated_rows_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2
    rows += [(7, (x[7] + 0.01 * rng.standard_normal(16)).tolist()) for _ in range(25)]  # one id, many vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1000, x[7].tolist()), (3, x[3].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in search(table, asked, target=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, v in ((1000, x[7]), (3, x[3])):
        best = {}
        for i, w in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(v @ np.array(w)))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        found = [i for _, i in sorted(got[q])]
        assert len(found) == 20 and len(set(found) & set(want)) >= 18
