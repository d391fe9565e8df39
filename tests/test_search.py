"""Hybrid search, fusion across vaults, graph and evaluation against plain Python over generated tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.vectors import dot, unit
from vellum.operators import evaluation, graph, multisearch, search
from vellum.operators.keyword_index import KeywordIndex, postings_of
from vellum.schema import GraphOptions, SearchOptions

CHUNK = "id long, vault string, model string, path string, idx int, heading string, text string, embedding array<float>"
QUERY = "qid long, query string, vec array<float>, own long"
POOL = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "jetty"]


def angle(degrees: float) -> list[float]:
    return [float(np.float32(f(math.radians(degrees)))) for f in (math.cos, math.sin)]


def corpus(rng, n=120):
    """(id, vault, model, path, idx, heading, text, vector): some without text or vector."""
    rows = []
    for i in range(n):
        vault = rng.choice(["north", "south", "west"])
        text = None if i % 17 == 0 else " ".join(rng.choice(POOL) + rng.choice(["", "", ".", "-"]) for _ in range(rng.randint(0, 30)))
        vec = None if i % 13 == 0 else angle(rng.uniform(0, 120))
        rows.append((i, vault, "m1" if vault == "north" else "m2", f"note{i // 3}.md", i % 3, rng.choice(POOL), text, vec))
    return rows


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# Plain versions


def plain_bm25(rows, query, weights, every=False):
    """id -> score over these chunks as one index; query: terms lists (phrases)."""
    columns = {r[0]: [words(r[3]), words(r[5]), words(r[6])] for r in rows}
    size = {i: sum(map(len, c)) for i, c in columns.items()}
    mean = sum(size.values()) / len(rows)
    places = lambda t, of: sum(of[k : k + len(t)] == t for k in range(len(of) - len(t) + 1))
    out, met = defaultdict(float), Counter()
    for phrase, n in Counter(map(tuple, query)).items():
        tf = {i: [places(list(phrase), of) for of in c] for i, c in columns.items()}
        hit = {i: sum(x * w for x, w in zip(f, weights)) for i, f in tf.items() if any(f)}
        idf = math.log(1 + (len(rows) - len(hit) + 0.5) / (len(hit) + 0.5))
        for i, w in hit.items():
            out[i] += n * idf * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * size[i] / mean))
            met[i] += 1
    return {i: s for i, s in out.items() if not every or met[i] == len(set(map(tuple, query)))}


def plain_band(sims, least, ratio, first):
    kept = []
    for n, s in enumerate(sims, 1):
        if s >= max(sims[0] * ratio, least) or n <= first:
            kept.append(n)
    return kept


def near(a, b):
    na, nb = math.hypot(*a), math.hypot(*b)
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


# Keyword leg


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(21))


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, CHUNK).cache()


ASKED = [(1, "amber birch"), (2, "cedar-delta"), (3, "The ember, and grove?"), (4, "fjord.fjord heath fjord.fjord"), (5, "absent"), (6, "note3.md inlet")]
TERMS = {1: [["amber"], ["birch"]], 2: [["cedar", "delta"]], 3: [["ember"], ["grove"]], 4: [["fjord", "fjord"], ["heath"], ["fjord", "fjord"]], 5: [["absent"]], 6: [["note3", "md"], ["inlet"]]}


def asked(spark, items=ASKED):
    return spark.createDataFrame([(q, t, None, None) for q, t in items], QUERY)


def scores_of(frame, *keys):
    return {tuple(r[k] for k in keys): round(r["score"], 9) for r in frame.collect()}


@pytest.mark.parametrize("every", [False, True])
def test_bm25_equals_the_formula(spark, rows, table, every):
    weights = (2.0, 1.5, 1.0)
    want = {(q, i): round(s, 9) for q, t in TERMS.items() for i, s in plain_bm25(rows, t, weights, every).items()}
    assert scores_of(search.bm25(asked(spark), postings_of(table), weights, every=every), "qid", "id") == want


def test_each_vault_is_an_index_of_its_own(spark, rows, table):
    want = {}
    for vault in ("north", "south", "west"):
        mine = [r for r in rows if r[1] == vault]
        want |= {(q, vault, i): round(s, 9) for q, t in TERMS.items() for i, s in plain_bm25(mine, t, (1, 1, 1)).items()}
    assert scores_of(search.bm25(asked(spark), postings_of(table), (1, 1, 1), scope=["vault"]), "qid", "vault", "id") == want


def test_the_stored_index_follows_the_notes(spark, rows, table, tmp_path):
    index = KeywordIndex.build(table, f"file://{tmp_path}/one")
    weights = (2.0, 1.5, 1.0)
    assert scores_of(search.bm25(asked(spark), index.postings(), weights), "qid", "id") == scores_of(search.bm25(asked(spark), postings_of(table), weights), "qid", "id")
    # note 3 changes and keeps an id, note 5 goes, a new note comes, a note of that name in another vault stays
    now = {r[0]: r for r in rows}
    gone = {(r[1], r[3]) for r in rows if r[3] in ("note3.md", "note5.md")}
    fresh = [(9, rows[9][1], "m1", "note3.md", 0, "cedar", "cedar delta amber inlet", None), (500, "west", "m2", "new.md", 0, "", "fjord fjord", None)]
    now = {i: r for i, r in now.items() if (r[1], r[3]) not in gone} | {r[0]: r for r in fresh}
    index.update(spark.createDataFrame(sorted(gone) + [("west", "new.md")], "vault string, path string"), spark.createDataFrame(fresh, CHUNK))
    index.update(spark.createDataFrame([("west", "new.md")], "vault string, path string"), spark.createDataFrame([(501, *fresh[1][1:])], CHUNK))
    now = {i: r for i, r in now.items() if i != 500} | {501: (501, *fresh[1][1:])}
    want = {(q, i): round(s, 9) for q, t in TERMS.items() for i, s in plain_bm25(list(now.values()), t, weights).items()}
    assert scores_of(search.bm25(asked(spark), index.postings(), weights), "qid", "id") == want
    whole = index.compact(f"file://{tmp_path}/two")
    assert whole.segments() == [0] and scores_of(search.bm25(asked(spark), whole.postings(), weights), "qid", "id") == want


def test_a_search_reads_the_folders_and_columns_it_needs(spark, table, tmp_path, capsys):
    index = KeywordIndex.build(table, f"file://{tmp_path}/one")
    alone = spark.createDataFrame([("amber", ["amber"])], "phrase string, terms array<string>")
    search.phrase_matches(alone, index.postings()).explain("formatted")
    scans = re.findall(r"Scan parquet.*?(?=\n\n)", capsys.readouterr().out, re.DOTALL)
    posted = [s for s in scans if "term" in s and "/postings" in s]
    one = [s for s in posted if "gaps" not in s]
    assert one and all(re.search(r"PartitionFilters:.*bucket#\d+ = \d+", s) for s in one)


def test_long_phrases_of_common_words(spark):
    """Places of phrases with common and repeated words against a scan; few phrases shuffle no postings."""
    rng = random.Random(29)
    texts = [" ".join(rng.choice(POOL[:3]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    asked = {" ".join(t.split()[i : i + n]) for t in texts[:20] for i, n in ((3, 2), (5, 3), (0, 5), (2, 9)) if t and len(t.split()) >= i + n} | {"amber nowhere birch", "amber amber"}
    table = spark.createDataFrame([(i, "v", "m", f"n{i}.md", 0, "", t, None) for i, t in enumerate(texts)], CHUNK)
    phrase = spark.createDataFrame([(p, p.split()) for p in sorted(asked)], "phrase string, terms array<string>")
    found = search.phrase_matches(phrase, postings_of(table))
    want = {(p, i): n for p in asked for i, t in enumerate(texts) if (n := sum((t or "").split()[j : j + len(p.split())] == p.split() for j in range(len((t or "").split()))))}
    assert {(r["phrase"], r["id"]): r["tfs"][2] for r in found.collect()} == want
    alone = search.phrase_matches(spark.createDataFrame([("amber", ["amber"])], "phrase string, terms array<string>"), postings_of(table))
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_all_then_any_scores_once(spark, rows, table, monkeypatch):
    seen, plain = [], search.bm25
    monkeypatch.setattr(search, "bm25", lambda *a, **how: seen.append(how) or plain(*a, **how))
    posted, options = postings_of(table), SearchOptions(k=3)
    got = defaultdict(list)
    for r in search.and_then_or(asked(spark), posted, options).orderBy("qid", "rn").collect():
        got[r["qid"]].append(r["id"])
    assert len(seen) == 1
    place, want = {r[0]: (r[3], r[4]) for r in rows}, {}
    for q, t in TERMS.items():
        whole, some = (plain_bm25(rows, t, options.weights, every) for every in (True, False))
        want[q] = sorted(some, key=lambda i: (i not in whole, -round(some[i], 9), place[i]))[: options.pool]
    assert got == {q: w for q, w in want.items() if w}


def test_an_unfinished_segment_does_not_count(spark, table, tmp_path):
    index = KeywordIndex.build(table, f"file://{tmp_path}/one")
    before = index.postings().rows.count()
    table.select(F.lit("x").alias("vault"), F.lit("amber").alias("term"), "id").limit(1).write.parquet(f"file://{tmp_path}/one/postings/segment=7/bucket=1")
    assert index.postings().rows.count() == before and index.segments() == [0]


def usable(query, stop):
    some = [t for t in query.split() if any(c.isalnum() for c in t)]
    return [t for t in some if t.lower() not in stop] or some


def test_queries_become_quoted_terms(spark):
    rng = random.Random(5)
    parts = ["the", "AND", "what", '"', "w\"q", "a.b", "--", "?", "Ключ", "zeta*", "(eta)", "12", "  ", "\t"]
    queries = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(150)})
    got = {r["q"]: r["e"] for r in spark.createDataFrame([(q,) for q in queries], "q string").select("q", T.match_expression(F.col("q")).alias("e")).collect()}
    assert got == {q: " OR ".join('"' + t.replace('"', '""') + '"' for t in usable(q, T.STOPWORDS)) for q in queries}


# Vector leg


def plain_near(rows, vec, own, k, least):
    sims = sorted(((near(vec, r[7]), r[0]) for r in rows if r[7] is not None and r[0] != own), key=lambda x: (-x[0], x[1]))
    return [(i, s) for s, i in sims if s >= least][:k]


@pytest.mark.parametrize(("centres", "block", "floor"), [(1, 8192, 0.2), (1, 16, 0.2), (9, 10, 0.6), (5, 7, -1.0)])
def test_nearest_over_any_blocks(spark, rows, table, monkeypatch, centres, block, floor):
    monkeypatch.setattr(search, "ROW_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    units = table.select("id", unit(F.col("embedding")).alias("u")).where("u is not null")
    got = defaultdict(list)
    for r in search.nearest(units.select(F.col("id").alias("qid"), F.col("id").alias("own"), "u"), units, 6, floor, centres=centres).orderBy("qid", "rn").collect():
        got[r["qid"]].append((r["id"], round(r["sim"], 6)))
    want = {r[0]: [(i, round(s, 6)) for i, s in plain_near(rows, r[7], r[0], 6, floor)] for r in rows if r[7] is not None}
    assert got == {q: w for q, w in want.items() if w}


def test_blocks_meet_whatever_the_partitions(spark, rows, table, monkeypatch):
    """Without coalesced partitions, blocks of both sides must be dealt alike."""
    monkeypatch.setattr(search, "LEAST_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        units = table.select("id", unit(F.col("embedding")).alias("u")).where("u is not null")
        got = defaultdict(list)
        for r in search.nearest(units.select(F.col("id").alias("qid"), F.col("id").alias("own"), "u"), units, 6, 0.2).orderBy("qid", "rn").collect():
            got[r["qid"]].append((r["id"], round(r["sim"], 6)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {r[0]: [(i, round(s, 6)) for i, s in plain_near(rows, r[7], r[0], 6, 0.2)] for r in rows if r[7] is not None}
    assert got == {q: w for q, w in want.items() if w}


def test_equal_vectors_tie_in_any_block(spark, monkeypatch):
    """Copies have the very same similarity, as if each pair were measured alone, and go by id."""
    for name in ("ROW_BLOCK", "QUERY_BLOCK", "LEAST_BLOCK"):
        monkeypatch.setattr(search, name, 5)
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(12, 64)).astype(np.float32)
    vectors = {i: kinds[i % 12] for i in range(96)}
    rows = [(i, f"v{i % 2}", v.tolist()) for i, v in vectors.items()] + [(96, "v0", [float("nan")] * 64)]
    table = spark.createDataFrame(rows, "id long, vault string, embedding array<float>")
    got = defaultdict(list)
    asked = table.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("id").alias("own"), F.col("embedding").alias("vec"))
    for r in search.vector_leg(asked, table, SearchOptions(k=2, min_sim=-1.0), ["vault"]).where("rn <= 8").orderBy("qid", "vault", "rn").collect():
        got[r["qid"], r["vault"]].append((r["id"], r["sim"]))

    def alone(a, b):
        dot = aa = bb = 0.0
        for x, y in zip(map(float, a), map(float, b)):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        return max(-1.0, min(1.0, dot / math.sqrt(aa * bb)))

    for q in range(0, 96, 4):
        for vault in (0, 1):
            best = sorted((-alone(vectors[q], v), i) for i, v in vectors.items() if i != q and i % 2 == vault)
            assert got[q, f"v{vault}"] == [(i, -s) for s, i in best[:8]]


def test_far_groups_are_not_compared(spark):
    units = spark.createDataFrame([(i, angle((i % 3) * 120 + i / 50)) for i in range(300)], "id long, u array<double>")
    at = search._centres(units, 12)
    pairs = search._pairs(search._grouped(units, "u", at, "_r"), search._grouped(units.withColumnRenamed("u", "q"), "q", at, "_q"), at, 0.9).count()
    assert pairs <= 12 * 12 / 2


def test_vectors_of_other_lengths_are_not_alike(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.8, 0.6])], "id long, u array<double>")
    found = search.nearest(table.select(F.col("id").alias("qid"), F.lit(None).cast("long").alias("own"), "u"), table, 5, 0.1).collect()
    assert {(r["qid"], r["id"]) for r in found} == {(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)}
    assert table.crossJoin(table.select(F.col("u").alias("v"))).where("size(u) <> size(v)").select(dot(F.col("u"), F.col("v")).alias("d")).distinct().collect() == [(0.0,)]


def test_the_band_is_a_fold_over_the_ranks(spark):
    rng = random.Random(13)
    legs, want = [], {}
    for q in range(60):
        sims = sorted((round(rng.uniform(0.2, 1), 3) for _ in range(rng.randint(1, 12))), reverse=True)
        least, ratio = 0.2, 0.75
        legs += [(q, n, s, n) for n, s in enumerate(sims, 1)]
        want[q] = plain_band(sims, least, ratio, 3)
    got = defaultdict(list)
    for r in search.band(spark.createDataFrame(legs, "qid long, id long, sim double, rn int"), SearchOptions()).orderBy("qid", "rn").collect():
        got[r["qid"]].append(r["rn"])
    assert got == want


# Fusion


def plain_search(rows, query, vec, o, weights=(2.0, 1.5, 1.0)):
    """[(id, vector rank, keyword rank)] of the hits, in order."""
    leg = plain_near(rows, vec, None, o.pool, o.min_sim) if vec else []
    legs = {leg[n - 1][0]: (n, leg[n - 1][1]) for n in plain_band([s for _, s in leg], o.min_sim, o.top_ratio, o.band_floor)} if leg else {}
    by = {r[0]: r for r in rows}
    scored = sorted(plain_bm25(rows, query, weights).items(), key=lambda x: (-round(x[1], 9), by[x[0]][3], by[x[0]][4]))[: o.pool]
    kw = {i: n for n, (i, _) in enumerate(scored, 1)}
    both = []
    for i in legs.keys() | kw.keys():
        v, k = legs.get(i), kw.get(i)
        share = o.keyword_weight / (o.rrf + k) if k else 0.0
        both.append((-((o.vector_weight / (o.rrf + v[0]) if v else 0.0) + share), -share, -(v[1] if v else 0.0), by[i][3], by[i][4], i))
    kept = []
    for *_, i in sorted(both):
        if not any(by[j][3] == by[i][3] and abs(by[j][4] - by[i][4]) <= 1 for j in kept):
            kept.append(i)
    return [(i, legs[i][0] if i in legs else 0, kw.get(i, 0)) for i in kept[: o.depth]]


@pytest.mark.parametrize("o", [SearchOptions(), SearchOptions(k=3, top_ratio=0.9, vector_weight=2.0, keyword_weight=0.5, rrf=20)])
def test_hybrid_search(spark, rows, table, o):
    vecs = {1: angle(10), 2: angle(60), 3: None, 4: angle(110), 5: angle(0), 6: [0.0, 0.0]}
    queries = spark.createDataFrame([(q, t, vecs[q], None) for q, t in ASKED], QUERY)
    distinct = table.withColumn("path", F.concat("vault", F.lit("/"), "path"))
    plain = [(*r[:3], f"{r[1]}/{r[3]}", *r[4:]) for r in rows]
    got = defaultdict(list)
    for r in search.search(queries, distinct, o).orderBy("qid", "pos").collect():
        got[r["qid"]].append((r["id"], r["vec_rank"], r["fts_rank"]))
    want = {q: plain_search(plain, TERMS[q], vecs[q] if q != 6 else None, o) for q, _ in ASKED}
    assert got == {q: w for q, w in want.items() if w}


def test_one_vault_alone_equals_the_fused_search_of_it(spark, rows, table):
    queries = spark.createDataFrame([(q, t, angle(17 * q), None) for q, t in ASKED], QUERY)
    alone = search.search(queries, table, SearchOptions(), scope=["vault"]).select("vault", "qid", "pos", F.col("id").alias("note"))
    fused = multisearch.model_groups(queries, table.withColumn("model", F.col("vault"))).select("vault", "qid", "pos", F.col("id").alias("note"))
    same = evaluation.parity(alone, fused, ["vault", "qid"]).collect()
    assert len(same) > 10 and all(r["same"] for r in same)


def test_keyword_legs_of_vaults_take_turns(spark, rows, table):
    legs = search.keyword_leg(asked(spark), postings_of(table), SearchOptions(), ["vault"]).collect()
    model = {r[0]: r[2] for r in rows}
    want = defaultdict(list)
    for r in sorted(legs, key=lambda r: (r["rn"], r["vault"])):
        want[r["qid"], model[r["id"]]].append(r["id"])
    got = defaultdict(list)
    for r in multisearch.interleaved_keywords(asked(spark), table, postings_of(table), SearchOptions()).orderBy("rn").collect():
        got[r["qid"], r["model"]].append(r["id"])
    assert got == want


def test_vector_legs_of_a_model_are_ranked_together(spark, rows, table):
    queries = spark.createDataFrame([(1, "", angle(30), None)], QUERY)
    o = SearchOptions(min_sim=0.3)
    got = {(r["model"], r["id"]): r["rn"] for r in multisearch.merged_vectors(queries, table, o).collect()}
    want = {}
    for m in ("m1", "m2"):
        legs = [(s, r[1], r[0]) for v in {r[1] for r in rows if r[2] == m} for i, s in plain_near([r for r in rows if r[1] == v], angle(30), None, o.pool, 0.3) for r in rows if r[0] == i]
        legs.sort(key=lambda x: (-x[0], x[1], x[2]))
        want |= {(m, legs[n - 1][2]): n for n in plain_band([s for s, *_ in legs], 0.3, o.top_ratio, 3)}
    assert got == want


def test_model_groups_come_by_their_best_hit(spark, table):
    queries = spark.createDataFrame([(q, t, angle(13 * q), None) for q, t in ASKED], QUERY)
    best = defaultdict(dict)
    for r in multisearch.model_groups(queries, table).collect():
        best[r["qid"]].setdefault(r["group_pos"], []).append((r["score"], r["model"]))
    for groups in best.values():
        tops = [(-max(s for s, _ in groups[g]), groups[g][0][1]) for g in sorted(groups)]
        assert tops == sorted(tops) and all(len({m for _, m in of}) == 1 for of in groups.values())


# Graph


def test_centroids(spark):
    rng = random.Random(3)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(3)]) for n in "abcd" for _ in range(rng.randint(1, 9))] + [("zero", [1.0, 0.0, 0.0]), ("zero", [-1.0, 0.0, 0.0]), ("none", None)]
    found = {r["note"]: r["u"] for r in graph.centroids(spark.createDataFrame(rows, "note string, embedding array<float>").repartition(3)).collect()}
    assert set(found) == set("abcd")
    for n, u in found.items():
        mean = [sum(v[i] for k, v in rows if k == n) for i in range(3)]
        assert u == pytest.approx([x / math.hypot(*mean) for x in mean], abs=1e-6)


@pytest.mark.parametrize(("k", "least"), [(6, 0.5), (1, 0.95), (0, 0.2)])
def test_graph_edges_equal_all_pairs(spark, k, least):
    rng = random.Random(k)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(150)} | {200: [1.0, 0.0, 0.0, 0.0], 201: [1.0, 0.0, 0.0, 0.0]}
    nodes = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").select("id", unit(F.col("v")).alias("u"))
    edges = graph.knn_edges(nodes, GraphOptions(k, least))
    want = {}
    for a, v in vectors.items():
        sims = sorted(((-near(v, w), b) for b, w in vectors.items() if b != a and near(v, w) >= least))[: max(k, 1)]
        want |= {(min(a, b), max(a, b)): -s for s, b in sims}
    assert {(r["a"], r["b"]): round(r["weight"], 9) for r in edges.collect()} == {e: round(s, 9) for e, s in want.items()}
    degree = Counter(x for e in want for x in e)
    assert {r["id"]: r["degree"] for r in graph.degrees(nodes, edges).collect()} == {i: degree[i] for i in vectors}


# Evaluation


def plain_scores(ranked, grades):
    gain = lambda of: sum(g / math.log2(n + 1) for n, g in enumerate(of[:10], 1))
    best, good = gain(sorted(grades.values(), reverse=True)), [n for n, g in grades.items() if g >= 2]
    first = next((n for n, x in enumerate(ranked[:10], 1) if grades.get(x, 0) >= 2), None)
    recall = lambda d: len([x for x in ranked[:d] if x in good]) / len(good) if good else None
    return (gain([grades.get(x, 0) for x in ranked]) / best if best else None, (1 / first if first else 0.0) if good else None, recall(5), recall(10))


def test_metrics(spark):
    rng = random.Random(17)
    hits, grades, want = [], [], {}
    for q in range(40):
        found = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
        graded = {n: rng.randint(0, 3) for n in rng.sample("abcdefghijklmnop", rng.randint(1, 8))}
        hits += [(q, n, x) for n, x in enumerate(found, 1)]
        grades += [(q, n, g) for n, g in graded.items()]
        want[q] = plain_scores(list(dict.fromkeys(found)), graded)
    ranked = evaluation.collapse(spark.createDataFrame(hits, "qid long, pos int, note string"))
    scored = evaluation.scores(ranked, spark.createDataFrame(grades, "qid long, note string, grade int"))
    for r in scored.collect():
        assert tuple(r)[1:] == pytest.approx(want[r["qid"]])
    known = [w[1] for w in want.values() if w[1] is not None]
    assert evaluation.macro(scored).first()["mrr10"] == pytest.approx(sum(known) / len(known))


def test_scores_by_label_equal_those_by_grades(spark):
    rng = random.Random(4)
    labels = [(n, rng.choice([1, 2, 3, None])) for n in range(40)]
    queries = [(q, labels[q][0], labels[q][1]) for q in range(0, 40, 3)]
    hits = [(q, pos, n) for q, *_ in queries[1:] for pos, n in enumerate(rng.sample(range(40), 15), 1)]
    ranked = evaluation.collapse(spark.createDataFrame(hits, "qid long, pos int, note long"))
    grades = [(q, n, 3 if n == own else 2) for q, own, label in queries for n, other in labels if label is not None and other == label]
    want = evaluation.scores(ranked, spark.createDataFrame(grades, "qid long, note long, grade int")).orderBy("qid").collect()
    got = evaluation.label_scores(ranked, spark.createDataFrame(queries, "qid long, own long, label int"), spark.createDataFrame(labels, "note long, label int")).orderBy("qid").collect()
    assert [r["qid"] for r in got] == [r["qid"] for r in want]
    for a, b in zip(got, want):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
