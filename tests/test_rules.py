"""Rules of chunking, names, versions, paths, callouts, marks and event lines, each with a case of its own."""

from pyspark.sql import functions as F

from vellum.functions import markdown as M
from vellum.functions import text as T
from vellum.operators import chunking, graph, stores
from vellum.schema import ChunkOptions, GraphOptions
from vellum.sources.labelled import run_events
from vellum.streaming.changes import QUIET, debounced


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "t string").select(use(F.col("t")).alias("x")).first()["x"]


def test_headings_keep_their_marks(spark):
    assert chunking.chunks_of("# Notes on F#\nx\n#\ty\n####### z\n#no", ChunkOptions()) == [("Notes on F#", "x\n#\ty\n####### z\n#no")]
    assert one(spark, "#\tno\n## Yes ##\n", M.first_heading) == "Yes ##"


def test_indented_fences_hide_headings():
    body = "- item\n\n      ```sh\n      # comment\n      ``` end\n# After"
    assert [c for c, _ in chunking.chunks_of(body + "\ntext", ChunkOptions())] == ["", "After"]
    assert [c for c, _ in chunking.chunks_of("~~~\n```\n# no\n~~~\n# yes\nt", ChunkOptions())] == ["", "yes"]


def test_long_paragraphs_stand_alone():
    assert [t for _, t in chunking.chunks_of("p" * 25 + "\n\nqq\n\nrr", ChunkOptions(20, 4).settled())] == ["p" * 20, "p" * 5, "qq\n\nrr"]
    assert [t for _, t in chunking.chunks_of("aa\n\n" + "p" * 25, ChunkOptions(20, 4).settled())] == ["aa", "p" * 20, "p" * 5]


def test_overlap():
    assert chunking.tail(b"red green blue", 40) == b"red green blue"
    assert chunking.tail(b"red green blue", 7) == b"blue" and chunking.tail(b"red green blue", 0) == b""
    assert chunking.tail("один два".encode(), 7) == "два".encode()


def test_versions_of_any_length(spark):
    order = ["1.alpha", "1.0.0.0.0.beta", "1", "1.0.0.0.0.1", "1.0.0.0.0.2", "1.2", "1.2.0.0.0.0.9", "1.10", "2"]
    rows = spark.createDataFrame([(v,) for v in order[::-1]], "v string").orderBy(T.version_key(F.col("v")))
    assert [r["v"] for r in rows.collect()] == order
    assert one(spark, "1.0.0", T.version_key) == one(spark, "1", T.version_key)


def test_path_escapes(spark):
    assert one(spark, "a b/c*d~e+f&g=h:i@j$k/ü%?", T.percent_encode) == "a%20b/c%2Ad~e+f&g=h:i@j$k/%C3%BC%25%3F"


def test_later_quotes_are_no_part_of_a_callout():
    found = M.callouts_of("> [!tip] Try\n> one\n\nplain\n\n> a quote\n> [!note]\n> two")
    assert [(c["title"], c["text"]) for c in found] == [("Try", "one"), ("Note", "two")]


def test_marks_stay_in_words(spark):
    assert one(spark, "re\u0301sume\u0301 Résumé क\u093cलम", T.tokens) == ["resume", "resume", "क\u093cलम"]


def test_one_neighbour_at_least(spark):
    rows = [(i, [1.0, 0.01 * i * i]) for i in range(4)]
    notes = spark.createDataFrame(rows, "id long, u array<double>")
    assert graph.knn_edges(notes, GraphOptions(0, 0.0)).count() == graph.knn_edges(notes, GraphOptions(1, 0.0)).count()


def test_quiet_time(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.4"), ("a", "2024-01-01 00:00:01.0")], "path string, t string")
    assert sorted(r["n"] for r in debounced(rows.withColumn("ts", F.to_timestamp("t"))).collect()) == [1, 2] and QUIET == "500 milliseconds"


def test_events_after_a_bad_line(spark):
    rows = [("s", 1, '{"type": "output"}'), ("s", 2, "junk"), ("s", 3, '{"type": "output"}'), ("t", 4, '{"type": "output"}')]
    got = run_events(spark.createDataFrame(rows, "s string, n long, value string"), stream="s", order="n").collect()
    assert sorted((r["s"], r["n"], r["ok"]) for r in got) == [("s", 1, True), ("s", 2, False), ("t", 4, True)]
