"""Free names against a loop, links against a parser of nested blocks, titles of targets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import links as L
from vellum.functions import markdown as M
from vellum.operators import free_names, linking


def one_by_one(asked, existing, suffix):
    taken, out = set(existing), {}
    for ord_, path in sorted(asked):
        m = re.search(r"\.[^./]*$", path)
        stem, ext = (path[: m.start()], m[0]) if m else (path, "")
        name, n = path, 0
        while name in taken:
            n += 1
            name = stem + suffix(n) + ext
        taken.add(name)
        out[ord_] = name
    return out


@pytest.mark.parametrize(("style", "suffix"), [
    (free_names.IMAGE, lambda n: f"-{n + 1}"), (free_names.IMPORT, lambda n: f" ({n})"), (free_names.UNTITLED, lambda n: f" {n}"),
    (free_names.RESTORED, lambda n: " (restored)" if n == 1 else f" (restored {n})"),
])
def test_names_are_given_as_by_a_loop(spark, style, suffix):
    rng = random.Random(2)
    bases = ["p.png", "d/p.png", "q", ".hidden", "a.b.md"]
    some = bases + [re.sub(r"(\.[^./]*)?$", lambda m: suffix(rng.randint(1, 4)) + (m[0] or ""), b, count=1) for b in bases for _ in range(3)]
    asked = [(i, rng.choice(some)) for i in range(200)]
    existing = sorted(set(rng.sample(some, 6)))
    frame = spark.createDataFrame(asked, "ord long, path string").repartition(5)
    got = free_names.allot(frame, spark.createDataFrame([(e,) for e in existing], "path string"), style)
    assert {r["ord"]: r["target"] for r in got.collect()} == one_by_one(asked, existing, suffix)


def test_images_of_a_document_get_three_names(spark):
    refs = spark.createDataFrame([("d", 1, "a/p.png", "p.png"), ("d", 2, "b/p.png", "p.png"), ("d", 3, "c/p-2.png", "p-2.png"), ("d", 4, "a/p.png", "p.png"), ("e", 1, "z/p.png", "p.png")], "doc string, ord long, image string, name string")
    got = {(r["doc"], r["image"]): r["name"] for r in free_names.image_names(refs, ["doc"]).collect()}
    assert got == {("d", "a/p.png"): "p.png", ("d", "b/p.png"): "p-2.png", ("d", "c/p-2.png"): "p-2-2.png", ("e", "z/p.png"): "p.png"}


def test_a_restore_never_meets_a_note(spark):
    notes = ["a.md", "a (restored).md", "b.md"]
    trashed = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "b.md"), (4, "c.md")], "ord long, path string")
    got = {r["ord"]: r["target"] for r in free_names.restore_names(trashed, spark.createDataFrame([(n,) for n in notes], "path string")).collect()}
    assert got == {1: "a (restored 2).md", 2: "a (restored 3).md", 3: "b (restored).md", 4: "c.md"}


@pytest.mark.parametrize(("text", "links"), [
    ("- a\n    - nested [[Note]]", ["Note"]), ("1. a\n\n    text [[x]]", ["x"]), ("text\n\n    [[code]]", []), ("text\n    [[lazy]]", ["lazy"]),
    ("- a\n\n      [[code]] deep", []), ("- a\n\n     [[text]] deep", ["text"]), ("- a\n\n        [[code]]", []), ("- a\n  ```\n  [[code]]\n  ```\n  [[b]]", ["b"]), ("- a\n  ```\n[[after]]", ["after"]),
    ("    [[code]]", []), ("# h\n    [[code]]", []), ("- - [[x]]", ["x"]), ("-    [[text]]", ["text"]), ("-     [[code]]", []), ("```\n[[c]]\n```\n[[d]]", ["d"]), ("a `[[s]]` [[t]]", ["t"]),
    ("- a\n\nout\n\n    [[code]]", []), ("\t[[code]]", []), ("* * *\n    [[code]]", []),
])
def test_links_in_nested_blocks(text, links):
    assert [t for t, _, _ in L.links_in(text)] == links


def test_an_indented_fence_hides_its_comments(spark):
    assert M.first_heading_of("- x\n    ```\n    # no\n    ```\n   # Yes") == "Yes"
    assert M.first_heading_of("~~~\n# no\n```\n# yes") == "yes" and M.first_heading_of("####### x\n#y\n#") is None


def test_links_show_titles(spark):
    notes = spark.createDataFrame([(1, "x/one.md", "# The First\n\n[[two]] [[two#Part|shown]] [[two#A/b]] [[lost]]"), (2, "two.md", "---\na: 1\n---\nno heading `[[one]]`"), (3, "z/two.md", "# Later in the walk"), (4, "n.md", None)], "id long, path string, body string")
    got = {r["id"]: r["text"] for r in linking.show_links(notes.select("id", "body"), notes).collect()}
    assert got[1] == "# The First\n\n[two](note:two) [shown](note:two#Part) [two › A/b](note:two#A%2Fb) [lost](note:lost)"
    assert got[2] == "---\na: 1\n---\nno heading `[[one]]`" and got[4] == ""
    flat = linking.show_links(spark.createDataFrame([(9, "to [[X/ONE.md]] and [[z/two#h]]")], "id long, body string"), notes, flat=True).first()["text"]
    assert flat == "to The First and two › h" or flat == "to The First and Later in the walk › h"


def test_spans_and_splices(spark):
    text = "é [[a]] 😀 [[b#c|d]]"
    row = spark.createDataFrame([(text,)], "t string").select("t", L.link_spans("t").alias("s")).select("s", L.splice(F.col("t"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["target"].alias("text")))).alias("o")).first()
    assert row["o"] == "é a 😀 b" and [tuple(s) for s in row["s"]] == [(2, 7, "a", "", ""), (10, 19, "b", "c", "d")]
