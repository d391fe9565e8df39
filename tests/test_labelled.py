"""Query sets, event lines, stored vectors and page-wise conversion."""

import json
import struct

from pyspark.sql import functions as F

from vellum.sources import labelled


def test_query_sets(spark, tmp_path):
    path = tmp_path / "queries.json"
    path.write_text(json.dumps([{"id": "a", "query": "one", "kind": "k", "relevant": {"n.md": 3, "m.md": 1}}, {"id": "b", "query": " ", "kind": "k", "relevant": {"n.md": 4}}, {"id": "a", "query": "two", "kind": "j", "relevant": {}}]))
    found = labelled.load_queries(spark, str(path))
    assert {tuple(r) for r in labelled.faults(found).collect()} == {("a", "repeated id"), ("b", "no text"), ("b", "grade beyond 1 to 3")}
    assert {tuple(r) for r in labelled.grades(found).where("qid = 'a'").collect()} == {("a", "n.md", 3), ("a", "m.md", 1)}
    assert [r["fault"] for r in labelled.faults(found.limit(0)).collect()] == ["no queries"]


def test_event_lines(spark):
    lines = spark.createDataFrame([('{"id":"1","type":"output","data":"x"}',), ("  ",), ("{oops",), ('{"id":"1","type":"odd"}',)], "value string")
    assert [r["ok"] for r in labelled.run_events(lines).collect()] == [True, False, False]


def test_stored_vectors(spark):
    rows = spark.createDataFrame([(1, bytearray(struct.pack("<2f", 1.5, -2.0))), (2, bytearray(b"123")), (3, None)], "id long, embedding binary")
    assert {r["id"]: r["embedding"] for r in labelled.stored_vectors(rows, dim=2).collect()} == {1: [1.5, -2.0], 2: None, 3: None}


def test_pixels(spark):
    rows = spark.createDataFrame([(2000, 1000), (10, 10), (9000000, 1)], "w int, h int").select(labelled.fit_pixels(F.col("w"), F.col("h"), F.lit(20000)).alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [(200, 100), (10, 10), (424264, 1)]


def test_pages_fall_back_to_their_raw_text(spark):
    def structure(raw, previous, headings):
        if raw == "bad":
            raise ValueError
        return "" if raw == "void" else f"# {raw} after {len(previous)}/{len(headings)}"

    rows = spark.createDataFrame([("d", 1, "a"), ("d", 2, "bad"), ("d", 3, "void"), ("d", 4, "b"), ("e", 1, "c")], "doc string, page int, raw string")
    found = {r["doc"]: r["markdown"] for r in labelled.structure_pages(rows, structure).collect()}
    assert found == {"d": "# a after 0/0\nbad\nvoid\n# b after 4/1", "e": "# c after 0/0"}
