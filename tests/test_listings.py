"""Cases of links, names and listings that the tables don't hold; orders of listings."""

from pyspark.sql import functions as F

from vellum.functions import links as L
from vellum.functions import markdown as M
from vellum.functions import text as T
from vellum.operators import listings
from vellum.plans import catalog

DATA = "/root/testdata/sf0.001"


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("c")).collect()[0]["c"]


def test_links_in_indented_code_and_spans_stay(spark):
    body = "    [[a]]\n``x ` [[b]]`` [[c d#e/f]]\n~~~\n[[g]]\n~~~\n[[h|]]"
    assert one(spark, (body,), "t string", L.rewrite_links("t")) == "    [[a]]\n``x ` [[b]]`` [c d › e/f](note:c%20d#e%2Ff)\n~~~\n[[g]]\n~~~\n[h](note:h)"
    assert one(spark, (None,), "t string", L.flatten_links("t")) == ""


def test_tables_of_links_and_code_in_sql(spark):
    from vellum.operators import tables

    tables.register(spark)
    body = "[[a#b|c]] `[[x]]`\n```sh\n[[y]]\n```\n[[d]]"
    spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("some_notes")
    assert spark.sql("SELECT id, n, target, heading, label FROM some_notes, LATERAL note_links(body) ORDER BY n").collect() == [(1, 0, "a", "b", "c"), (1, 1, "d", "", "")]
    assert spark.sql("SELECT id, idx, lang, code FROM some_notes, LATERAL note_code(body)").collect() == [(1, 0, "sh", "[[y]]\n")]
    chunks = spark.sql("SELECT id, idx, text FROM some_notes, LATERAL note_chunks(body)").collect()
    assert [(r.id, r.idx) for r in chunks] == [(1, 0)] and "[[d]]" in chunks[0].text


def test_properties_keep_order_and_body(spark):
    props = "p array<struct<key: string, values: array<string>>>"
    write = M.replace_properties(F.col("t"), F.col("p"))
    some = [("z", ["1"]), ("a b", ["x: y", "w"]), ("n", [])]
    assert one(spark, ("---\nold: 1\n---\r\nbody\r\n", some), f"t string, {props}", write) == "---\nz: 1\na b:\n    - 'x: y'\n    - w\nn:\n---\nbody\r\n"
    assert one(spark, ("---\nold: 1\n---\nbody", []), f"t string, {props}", write) == "body"
    assert one(spark, ("body", None), f"t string, {props}", write) == "body"


def test_places_do_not_overlap(spark):
    assert one(spark, ("aAa.aa", "aa"), "t string, n string", L.find_in_note(F.col("t"), F.col("n"))) == [0, 4]
    assert one(spark, (None, ""), "t string, n string", L.find_in_note(F.col("t"), F.col("n"))) == []


def test_assignments_of_bad_form(spark):
    assert one(spark, (["a=1=2", "b= , "],), "s array<string>", T.assignments(F.col("s")))["props"] == [("a", ["1=2"]), ("b", [])]
    assert one(spark, (["=1"],), "s array<string>", T.assignments(F.col("s"))) == (False, None)


def test_folder_is_not_moved_into_itself(spark):
    notes = spark.createDataFrame([("a/x.md",), ("ab/x.md",)], "path string")
    assert listings.move_folder(notes, "a", "a/b").collect() == [("a/x.md", "a/x.md", "skipped")]
    assert listings.delete_prefix(notes, "a", "path").collect() == [("ab/x.md",)]


def test_moves_onto_others(spark):
    notes = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("c.md",)], "path string")
    assert listings.move_folder(notes, "a", "b").collect() == [("a/x.md", "a/x.md", "refused")]
    assert listings.move_folder(notes, "a", "new").collect() == [("a/x.md", "new/x.md", "moved")]
    moves = spark.createDataFrame([("a/x.md", "c"), ("b/y.md", "c.md"), ("c.md", "c.md"), ("no.md", "z")], "path string, target string")
    assert {tuple(r) for r in listings.move_notes(notes, moves).collect()} == {("a/x.md", "a/x.md", "refused"), ("b/y.md", "b/y.md", "refused"), ("c.md", "c.md", "skipped"), ("no.md", "no.md", "missing")}
    over = {tuple(r) for r in listings.move_notes(notes, moves, F.lit("1")).collect()}
    assert over == {("a/x.md", "c.md", "moved"), ("c.md", ".trash/1/c.md", "trashed"), ("b/y.md", "b/y.md", "refused"), ("c.md", "c.md", "skipped"), ("no.md", "no.md", "missing")}


def test_letters_of_large_numbers(spark):
    """Five letters and more; numbers that doubles don't tell apart."""
    letters = {475254: "zzzz", 475255: "aaaaa", 12356631: "aaaaaa", 14636698788954112: "cyqtaeuocyaz", 2**63 - 1: "crpxnlskvljfhg"}
    rows = spark.createDataFrame([(n,) for n in letters], "n long")
    assert {r["n"]: r["s"] for r in rows.select("n", listings.letter_ordinal(F.col("n")).alias("s")).collect()} == letters


def test_trash_is_emptied(spark):
    notes = spark.createDataFrame([("a.md",), (".trash/1/a.md",), ("b/.trash/1/c.md",)], "path string")
    assert sorted(r.path for r in listings.empty_trash(notes).collect()) == ["a.md", "b/.trash/1/c.md"]


def test_listings_come_in_order(spark):
    found = [(r.updated_at, r.id) for r in catalog.QUERIES["sessions_recent"](spark, DATA).collect()]
    assert found == sorted(found, reverse=True)
    trash = [r.trash_id for r in catalog.QUERIES["trash_listing"](spark, DATA).collect()]
    assert trash == sorted(trash, reverse=True)
    edges = [(r.a, r.b) for r in catalog.QUERIES["knn_edges"](spark, DATA).collect()]
    assert edges == sorted(edges)
