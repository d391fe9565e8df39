"""Chunking, Markdown, conversion and embedding on small literal inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import markdown as M
from vellum.operators import chunking, embedding
from vellum.schema import ChunkOptions
from vellum.sources.html import markdown_of
from vellum.sources.notes import note_relative, walk_vault
from vellum.sources.office import join_runs


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_sections_carry_their_breadcrumbs():
    body = "intro\n# Title\nbody\n## Sub\nmore\n```\n# no heading\n```\n# Other\nend"
    assert chunking.chunks_of(body, ChunkOptions()) == [("", "intro"), ("Title", "body"), ("Title › Sub", "more\n```\n# no heading\n```"), ("Other", "end")]
    trail = "# A\na\n## B\nb\n### C\nc\n## D\nd\n# E\ne"
    assert [c for c, _ in chunking.chunks_of(trail, ChunkOptions())] == ["A", "A › B", "A › B › C", "A › D", "E"]


def test_windows_overlap_and_stay_within_their_bytes():
    body = "\n\n".join("x" * 99 + str(i) for i in range(10))
    parts = [t for _, t in chunking.chunks_of(body, ChunkOptions(300, 50))]
    assert len(parts) > 3 and max(len(p.encode()) for p in parts) <= 300
    assert [len(t) for _, t in chunking.chunks_of("x" * 1000, ChunkOptions(200, 20))] == [200] * 5
    for text in ("привет мир " * 60, "😀" * 100):
        assert all(len(t.encode()) <= 64 for _, t in chunking.chunks_of(text, ChunkOptions(64, 8)))
    assert ChunkOptions(0, 5).settled() == ChunkOptions() and ChunkOptions(80, 90).settled() == ChunkOptions(80, 10)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é😀\n", max_size=400), st.integers(8, 60))
def test_chunks_hold_every_word(text, size):
    options = ChunkOptions(size, 0)
    parts = [t for _, t in chunking.chunks_of(text, options)]
    assert all(len(p.encode()) <= size for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


@pytest.mark.parametrize("source, block, body", [
    ("---\na: 1\n---\nbody", "a: 1\n", "body"), ("---\r\na: 1\r\n---\r\nbody", "a: 1\r\n", "body"), ("---\n---\nbody", "", "body"),
    ("----\na\n---\n", None, "----\na\n---\n"), ("body", None, "body"), ("---\na: 1\n---", "a: 1\n", ""), ("x\n---\na: 1\n---\n", None, "x\n---\na: 1\n---\n"),
])
def test_frontmatter(spark, source, block, body):
    assert one(spark, source, M.frontmatter_block) == block and one(spark, source, M.note_body) == body
    assert one(spark, source, lambda x: M.note_body(M.replace_body(x, F.lit("new")))) == "new"


def test_properties_keep_their_order_and_text(spark):
    found = one(spark, "tags: [a, b]\nwhen: 2024-01-01\nempty:\nyes: yes\nAliases: x", M.properties)
    assert [(p["key"], p["values"]) for p in found] == [("tags", ["a", "b"]), ("when", ["2024-01-01"]), ("empty", []), ("yes", ["yes"]), ("Aliases", ["x"])]
    assert one(spark, "a: [", M.properties) == [] and one(spark, "- a", M.properties) == []


def test_code_blocks_and_links(spark):
    body = '```Python kernel="py" version="3\nprint(1)\n```\n\n[[a#h|l]] `[[no]]`\n\n~~~\n[[no]]\n~~~'
    blocks = one(spark, body, M.code_blocks)
    assert [(b["idx"], b["lang"], b["kernel"], b["version"], b["code"]) for b in blocks] == [(0, "python", "py", "", "print(1)\n"), (1, "", "", "", "[[no]]\n")]
    links = one(spark, body, lambda x: M.wikilinks(M.without_code(x)))
    assert [(x["target"], x["heading"], x["label"]) for x in links] == [("a", "h", "l")]
    assert one(spark, "```\n# no\n```\n## Yes ##\n# Later", M.first_heading) == "Yes ##"
    assert one(spark, "a\n", M.block_hash) == one(spark, "a", M.block_hash) != one(spark, "a\n\n", M.block_hash)


def test_callouts(spark):
    found = one(spark, "> [!warning] Mind this\n> text\n> > [!odd]\n> > deep", M.callouts)
    assert [(c["kind"], c["title"], c["icon"], c["depth"], c["text"]) for c in found] == [("warning", "Mind this", "exclamation-triangle", 1, "text"), ("odd", "Odd", "info-circle", 2, "deep")]


@pytest.mark.parametrize("html, text", [
    ("<h1>T</h1><p>a <b>b</b> <em>c</em></p>", "# T\n\na **b** *c*"), ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ('<a href="u">t</a>', "[t](u)"), ("<table><tr><th>a</th></tr><tr><td>b</td></tr></table>", "| a |\n| --- |\n| b |"), ("<zz>kept</zz>", "kept"), ("", ""),
    ("<script>x</script>y", "y"), ("<pre><code>a\n b</code></pre>", "```\na\n b\n```"),
])
def test_html(html, text):
    assert markdown_of(html) == text


def test_runs_of_a_page(spark):
    rows = [("d", 1, 0, "Hel", 0.0, 10.0, 20.0, 10.0), ("d", 1, 1, "lo", 20.0, 10.0, 10.0, 10.0), ("d", 1, 2, "world", 35.0, 10.0, 30.0, 10.0), ("d", 1, 3, "next", 0.0, 30.0, 20.0, 10.0)]
    runs = spark.createDataFrame(rows, "doc string, page int, ord int, s string, x double, y double, w double, font_size double")
    assert join_runs(runs).first()["text"] == "Hello world\nnext"


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.md", "c.png"), ("a/b.md", "../c.png"), ("a/b.md", "../../c.png"), ("b.md", "/x/./d.png")], "note string, src string")
    assert [r[0] for r in rows.select(note_relative(F.col("note"), F.col("src"))).collect()] == ["a/c.png", "c.png", None, "x/d.png"]


def test_walk_skips_hidden_folders(spark, tmp_path):
    for name in ("a.md", "sub/b.MARKDOWN", ".hid/c.md", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r["path"] for r in walk_vault(spark, str(tmp_path)).collect()} == {"a.md", "sub/b.MARKDOWN"}


def test_failed_batches_leave_the_others_alone(spark):
    good = embedding.hashing_embedder(8)

    def poisoned(some):
        if any("poison" in t for t in some):
            raise ValueError("bad text")
        return good(some)

    rows = spark.createDataFrame([(i, "poison" if i == 3 else f"word{i}") for i in range(200)], "id long, text string").coalesce(1)
    done, failed = embedding.good_and_failed(embedding.embed_texts(rows, poisoned, concurrency=1))
    assert done.count() == 199 and [r["id"] for r in failed.collect()] == [3]
    assert "bad text" in failed.first()["error"]


def test_passing_failures_are_tried_again():
    calls = []

    def flaky(some):
        calls.append(1)
        if len(calls) < 3:
            raise embedding.Passing
        return [[1.0]] * len(some)

    slept = []
    assert embedding.attempt(flaky, ["a"], sleep=slept.append) == [[1.0]] and len(calls) == 3
    assert 0.75 <= slept[0] <= 1.25 and 1.5 <= slept[1] <= 2.5
    with pytest.raises(ValueError):
        embedding.attempt(lambda some: [], ["a"], sleep=slept.append)
    assert len(slept) == 2


def test_loading_has_a_budget_of_its_own():
    now, slept = [0.0], []

    def wait(seconds):
        slept.append(seconds)
        now[0] += seconds

    def loading(until):
        def embed(some):
            if now[0] < until:
                raise embedding.Loading("soon")
            return [[1.0]] * len(some)

        return embed

    assert embedding.attempt(loading(400), ["a"], sleep=wait, clock=lambda: now[0]) == [[1.0]] and max(slept) <= 5 * 1.25
    now[0] = 0.0
    with pytest.raises(embedding.Loading):
        embedding.attempt(loading(10_000), ["a"], sleep=wait, clock=lambda: now[0])
    assert 500 < now[0] <= 700


def test_vectors_are_matched_by_place():
    assert embedding.in_order([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for got in ([(0, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [2.0])], [[1.0]]):
        with pytest.raises(embedding.WrongAnswer):
            embedding.in_order(got, 2)


def test_a_failing_batch_is_halved_until_the_bad_texts_stand_alone():
    calls = []

    def embed(some):
        calls.append(len(some))
        if any(t.startswith("bad") for t in some):
            raise RuntimeError("no")
        return [[float(len(t))] for t in some]

    texts = [("bad" if i in (5, 40) else "t") + str(i) for i in range(64)]
    found = embedding.isolated(embed, texts)
    assert [i for i, (v, e) in enumerate(found) if e] == [5, 40] and found[7] == ([2.0], None) and len(calls) <= 2 * 2 * 7
