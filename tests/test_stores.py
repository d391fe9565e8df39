"""Sync, keyed tables, names and change streams on small literal tables."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import stores, sync
from vellum.streaming.changes import classify, complete_runs, debounce_stream, debounced, sync_on_changes

NOTE = "path string, doc_hash string"


def test_sync_plan(spark):
    disk = spark.createDataFrame([("new.md", "1"), ("same.md", "2"), ("changed.md", "3")], NOTE)
    stored = spark.createDataFrame([("same.md", "2"), ("changed.md", "0"), ("gone.md", "9")], NOTE)
    planned = sync.plan(disk, stored)
    assert {r["path"]: r["action"] for r in planned.collect()} == {"new.md": "index", "same.md": "skip", "changed.md": "index", "gone.md": "prune"}
    assert tuple(sync.stats(planned).first()) == (2, 1, 1) and tuple(sync.stats(sync.plan(disk, stored, True)).first()) == (3, 0, 1)
    left = sync.replace_notes(stored, planned.where("action <> 'skip'"), disk.where("path <> 'same.md'"))
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in disk.collect()}


def test_errors_are_counted_and_sampled(spark):
    some = spark.createDataFrame([(f"n{i:02}.md", "bad") for i in range(13)], "path string, error string")
    row = sync.error_sample(some).first()
    assert row["n"] == 13 and row["sample"].startswith("n00.md: bad; ") and row["sample"].endswith(" and 3 more")


def test_keyed_rows(spark):
    schema = "note string, h string, t int"
    old, new = spark.createDataFrame([("a", "1", 1), ("a", "2", 1)], schema), spark.createDataFrame([("a", "1", 5), ("b", "1", 2)], schema)
    assert {tuple(r) for r in stores.upsert(old, new, ["note", "h"], ["t"]).collect()} == {("a", "1", 5), ("a", "2", 1), ("b", "1", 2)}
    assert [tuple(r) for r in stores.insert_if_absent(old, new, ["note", "h"], ["t"]).collect()] == [("b", "1", 2)]
    edited = spark.createDataFrame([("a",)], "note string")
    kept = spark.createDataFrame([("a", "2")], "note string, h string")
    assert {tuple(r)[:2] for r in stores.prune_not_in(old.unionByName(new), kept, edited, ["note", "h"], "note").collect()} == {("a", "2"), ("b", "1")}
    assert stores.prune_not_in(old, kept.limit(0), edited, ["note", "h"], "note").count() == 0


def test_moved_rows_win(spark):
    rows = spark.createDataFrame([("x/a.md", 1), ("y/a.md", 2), ("xx/b.md", 3)], "path string, v int")
    assert {tuple(r) for r in stores.rename_prefix(rows, "x", "y", "path", ["path"]).select("path", "v").collect()} == {("y/a.md", 1), ("xx/b.md", 3)}


def test_sessions(spark):
    heads = spark.createDataFrame([(1, 10, 10), (2, 20, 20)], "id long, created_at long, updated_at long")
    turns = spark.createDataFrame([(1, 1, 15), (2, 1, 18)], "id long, session_id long, created_at long")
    assert {r["id"]: r["updated_at"] for r in stores.bump(heads, turns).collect()} == {1: 18, 2: 20}
    kept, left = stores.delete_cascade(heads, turns, spark.createDataFrame([(1,)], "id long"), "id", "session_id")
    assert [r["id"] for r in kept.collect()] == [2] and left.count() == 0


def test_names_and_trash(spark):
    rows = spark.createDataFrame([("20240102T030405-2", "d/n.md"), ("junk", "x.md")], "trash_id string, rel string")
    found = {r["trash_id"]: r for r in stores.trash_listing(rows).collect()}
    assert str(found["20240102T030405-2"]["deleted_at"]) == "2024-01-02 03:04:05" and found["junk"]["deleted_at"] is None
    assert found["junk"]["trash_path"] == ".trash/junk/x.md"


@pytest.mark.parametrize("old, status, body", [("one", "edited", "X two two"), ("two", "ambiguous", "one two two"), ("no", "not found", "one two two"), ("", "not found", "one two two")])
def test_anchor(spark, old, status, body):
    row = spark.createDataFrame([("one two two",)], "b string").select(stores.anchor_edit(F.col("b"), F.lit(old), F.lit("X")).alias("e")).first()["e"]
    assert (row["status"], row["body"]) == (status, body)


def test_links_go_to_the_first_note_in_walk_order(spark):
    notes = spark.createDataFrame([("b/Note.md",), ("a/note.md",), ("top.md",)], "path string")
    links = spark.createDataFrame([(1, "note"), (2, "B/note"), (3, "Top.md"), (4, "none")], "link_id long, target string")
    assert {r["link_id"]: r["path"] for r in stores.resolve_links(links, notes).collect()} == {1: "a/note.md", 2: "a/note.md", 3: "top.md", 4: None}


def test_kernels(spark):
    kernels = spark.createDataFrame([("py", "3.9", ["python"], "shared"), ("py", "3.10", ["python", "py"], "shared"), ("zz", "9", ["python"], "vault")], "family string, version string, match array<string>, source string")
    blocks = spark.createDataFrame([(1, "python"), (2, "py"), (3, "go")], "block_id long, lang string")
    assert {r["block_id"]: (r["family"], r["version"]) for r in stores.choose_kernels(blocks, kernels).collect()} == {1: ("py", "3.10"), 2: ("py", "3.10"), 3: (None, None)}


def test_change_classes(spark):
    rows = spark.createDataFrame([("create", "d", True), ("remove", "d", False), ("write", "a.md", False), ("write", "a.png", False), ("remove", "a.md", False)], "op string, path string, is_dir boolean")
    assert [r[0] for r in rows.select(classify(F.col("op"), F.col("path"), F.col("is_dir"))).collect()] == ["vault", "vault", "note", "ignore", "note"]


EVENTS = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:00:00")]


def test_debounce(spark, tmp_path):
    rows = spark.createDataFrame(EVENTS, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    assert sorted((r["path"], r["n"]) for r in debounced(rows, "30 minutes").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    for i, part in enumerate((rows, spark.createDataFrame([("late", "2024-01-02 00:00:00")], "path string, t string").select("path", F.to_timestamp("t").alias("ts")), spark.createDataFrame([("late", "2024-01-03 00:00:00")], "path string, t string").select("path", F.to_timestamp("t").alias("ts")))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    query = debounce_stream(stream, "30 minutes").writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["path"], r["n"]) for r in seen if r["path"] != "late") == [("a", 1), ("a", 2), ("b", 1)]


def test_a_folder_change_supersedes_its_notes(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "note"), ("d", "vault")], "path string, kind string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    done = []
    stream = spark.readStream.schema("path string, kind string").parquet(f"{tmp_path}/in")
    sync_on_changes(stream, lambda: done.append("vault"), lambda notes: done.append(sorted(r["path"] for r in notes.collect())), f"{tmp_path}/cp").awaitTermination(60)
    assert done == ["vault"]


def test_runs_without_an_end_are_left_out(spark):
    rows = [(1, 0, "output", "a", 0, 0), (1, 1, "output", "b", 0, 0), (1, 2, "done", "", 3, 9), (1, 3, "output", "late", 0, 0), (2, 0, "output", "x", 0, 0)]
    found = complete_runs(spark.createDataFrame(rows, "run_id long, ord int, type string, data string, code int, dur_ms int")).collect()
    assert [tuple(r) for r in found] == [(1, "ab", 3, 9)]
