from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op07_substring_dedup import deduplicate, remove, units

PASSAGE = "the first sentence of this passage has more than eight words in it. the second sentence of it is just as long as the first one."


def brute(rows):
    seen, gone = {}, {}
    rows = sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0], r[1]))
    for i, t in rows:
        for a, b, form in units(t):
            rank = ((i is None, i or 0), t, a, b)
            if form not in seen or rank[:1] + rank[2:] == seen[form]:
                seen.setdefault(form, rank[:1] + rank[2:])
            else:
                gone.setdefault((i, t), []).append((a, b))
    return {k: remove(k[1], v)[0] for k, v in gone.items()}


def test_against_brute_force(spark):
    rows = [r for r in texts() if r[0] != 81]
    got = deduplicate(documents(spark, rows), report=True).collect()
    want = brute(rows)
    source = {(i, t or "") for i, t, _ in rows}
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), want.get((i, t or ""), t or "")) for i, t, _ in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[60]["n_removed"] == 0 and all(by[i]["n_removed"] == 1 for i in range(61, 68))
    for r in got:  # offsets are those of the original text
        old = next(t for i, t in source if i == r["doc_id"])
        kept, at = "", 0
        for s in r["removed"]:
            kept, at = kept + old[at : s["start"]], s["end"]
        assert kept + old[at:] == r["text"]


def test_passage_inside_lines(spark):
    rows = [(1, f"alpha beta. {PASSAGE} gamma delta.", "a"), (2, f"one two. {PASSAGE} three.", "a"), (3, f"start\n{PASSAGE}\nend", "a")]
    got = {r["doc_id"]: r["text"] for r in deduplicate(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "one two. three.", 3: "start\nend"}


def test_columns_stay(spark):
    docs = documents(spark)
    out = deduplicate(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert {r["score"] for r in out.collect()} == {9.5}
    assert deduplicate(nothing(spark)).collect() == []


def kept(spark, rows):
    return {r["doc_id"]: r["text"] for r in deduplicate(documents(spark, [(i, t, "a") for i, t in rows.items()])).collect()}


def test_passages_of_short_pieces(spark):
    lines = "\n".join(f"item{i} costs money{i}" for i in range(20))
    sentences = " ".join(f"He{i} saw them{i}. No{i}!" for i in range(15))
    long = " ".join(f"word{i}" for i in range(200))
    wrapped = [f"{'a' * (i % 7 + 1)}{i}" for i in range(60)]
    wrapped[29] += "."
    first = {1: f"top one\n{lines}\nend one", 2: f"top two\n\n{lines}\nend two"}
    first |= {3: f"open three {sentences} close three", 4: f"open four. {sentences} close four"}
    first |= {5: f"some three words {long} tail five", 6: f"other words {long} tail six"}
    first |= {7: "Head.\n" + " ".join(wrapped[:10]) + "\n" + " ".join(wrapped[10:]) + ".", 8: "\n".join(" ".join(wrapped[i : i + 4]) for i in range(0, 60, 4)) + "."}
    got = kept(spark, first)
    assert all(got[i] == first[i] for i in (1, 3, 5, 7))
    assert got[2] == "top two\n\nend two"
    assert got[4] == "open four. He0 saw them0. close four"  # in 3 that sentence starts otherwise
    assert sum(w.startswith("word") for w in got[6].split()) < 100
    assert len(got[8].split()) == 0


def test_texts_without_blanks(spark):
    line = "这个段落在许多文档里重复出现而且没有空格所以整行只算一个词"
    passage = "我们在这里写下第一个很长的句子用来测试。然后再写下第二个同样很长的句子用来测试！"
    got = kept(spark, {1: f"甲\n{line}\n乙", 2: f"丙\n{line}\n丁", 3: f"开头甲。{passage}结尾。", 4: f"别的。{passage}不同。"})
    assert got == {1: f"甲\n{line}\n乙", 2: "丙\n丁", 3: f"开头甲。{passage}结尾。", 4: "别的。不同。"}


def test_a_short_line_again_and_again_keeps_its_first_run(spark):
    assert kept(spark, {1: "\n".join(["yes indeed"] * 20)})[1].split("\n") == ["yes indeed"] * 4


def test_hot_and_other_digests_give_the_same_spans(spark):
    from vellum.llm.op07_substring_dedup import removals

    docs = documents(spark)

    def found(hot):
        return sorted((str(r["_id"]), r["_h"], sorted(map(tuple, r["spans"]))) for r in removals(docs, hot=hot).collect())

    assert found(1) == found(20) == found(1_000_000) != []
