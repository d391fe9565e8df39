"""Vault folders as source, sink and stream of changes; streaming run states against the batch form."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import runs
from vellum.sources import vault
from vellum.streaming import changes, run_states


def make(root, files, folders=()):
    for f in folders:
        os.makedirs(root / f, exist_ok=True)
    for name, text in files.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(text)


FILES = {
    "a.md": "---\ntags: [x, y]\nalias: z\n---\nbody", "a/b.MD": "b", "a-b.md": "c", "_draft.md": "d", ".dot.md": "e", "_in/_f.markdown": "f", "pic.png": "g",
    ".trash/1/old.md": "h", ".obsidian/app.md": "i", "deep/er/x.md": "j",
}


def test_notes_and_hidden_folders(spark, tmp_path):
    make(tmp_path, FILES, ["empty/inner", ".git"])
    notes = {r["path"]: r for r in vault.read_notes(spark, str(tmp_path)).collect()}
    assert set(notes) == {"a.md", "a/b.MD", "a-b.md", "_draft.md", ".dot.md", "_in/_f.markdown", "deep/er/x.md"}
    assert notes["a/b.MD"]["body"] == "b" and notes["a.md"]["created"] is not None and notes["a.md"]["modified"] is not None
    assert vault.Folder(f"file:{tmp_path}").base == vault.Folder(f"file://{tmp_path}").base == str(tmp_path)
    all_ = vault.read_notes(spark, f"file://{tmp_path}", hidden=True)
    assert {".trash/1/old.md", ".obsidian/app.md"} <= {r["path"] for r in all_.collect()} and all_.count() == 9
    walked = [r["path"] for r in vault.read_notes(spark, str(tmp_path)).orderBy(vault.walk_key()).collect()]
    assert walked.index("a/b.MD") < walked.index("a-b.md") < walked.index("a.md")


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_every_entry_comes_once(spark, tmp_path, parts):
    make(tmp_path, {f"d{i % 5}/e{i % 3}/n{i}.md": "x" * i for i in range(60)}, ["d9"])
    vault.register(spark)
    rows = spark.read.format("vault").options(path=str(tmp_path), partitions=str(parts), content="false").load().collect()
    assert len(rows) == len({r["path"] for r in rows}) == 60 + 5 + 15 + 1
    assert all(r["content"] is None for r in rows) and {r["path"]: r["size"] for r in rows}["d1/e1/n31.md"] == 31


def test_tree_with_tags_and_empty_folders(spark, tmp_path):
    make(tmp_path, FILES, ["empty/inner"])
    tree = {r["path"]: r for r in vault.read_tree(spark, str(tmp_path)).collect()}
    assert tree["a.md"]["tags"] == ["x", "y"] and tree["a.md"]["aliases"] == ["z"] and tree["a.md"]["name"] == "a"
    assert tree["empty/inner"]["is_dir"] and tree["empty/inner"]["parent"] == "empty" and tree["pic.png"]["name"] == "pic.png" and not tree["pic.png"]["is_note"]
    assert ".obsidian" not in tree and tree["empty"]["parent"] == ""


def test_notes_are_written_removed_and_refused(spark, tmp_path):
    make(tmp_path, {"a.md": "old", "b.md": "old"})
    rows = spark.createDataFrame([("a.md", "new"), ("b.md", None), ("c/d.md", "ü"), ("no.md", None)], "path string, body string")
    vault.write_notes(rows, str(tmp_path), report=f"{tmp_path}.json")
    assert (tmp_path / "a.md").read_text() == "new" and not (tmp_path / "b.md").exists() and (tmp_path / "c/d.md").read_text() == "ü"
    assert json.loads(open(f"{tmp_path}.json").read()) == {"written": 2, "removed": 1, "refused": 0}
    vault.write_notes(spark.createDataFrame([("a.md", "newer"), ("e.md", "e")], "path string, body string"), str(tmp_path), "refuse", f"{tmp_path}.json")
    assert (tmp_path / "a.md").read_text() == "new" and json.loads(open(f"{tmp_path}.json").read()) == {"written": 1, "removed": 0, "refused": 1}
    with pytest.raises(Exception, match="inside the vault"):
        vault.write_notes(spark.createDataFrame([("../x.md", "x")], "path string, body string"), str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.md", "d.md", "e.md"]


def test_changes_reach_the_sync(spark, tmp_path):
    root, seen = tmp_path / "v", []
    root.mkdir()

    def step():
        rows = vault.changes(spark, str(root), str(tmp_path / "state")).withColumn("kind", changes.classify(F.col("op"), F.col("path"), F.col("is_dir")))
        changes.sync_on_changes(rows, lambda: seen.append("vault"), lambda notes: seen.append(sorted(r["path"] for r in notes.collect())), str(tmp_path / "checkpoint")).awaitTermination()

    make(root, {"a.md": "1", "b.md": "1", "x.png": "1"})
    step()
    assert seen == [["a.md", "b.md"]]
    step()  # nothing has changed
    assert seen == [["a.md", "b.md"]]
    make(root, {"a.md": "longer", ".hidden/n.md": "1"})
    os.remove(root / "b.md")
    step()
    assert seen[1:] == [["a.md", "b.md"]]
    make(root, {"d/e.md": "1", "a.md": "and longer"})
    step()
    assert seen[2:] == ["vault"]
    os.rename(root / "d", root / "f")
    step()
    assert seen[3:] == ["vault"] and len(os.listdir(tmp_path / "state")) <= 2


EVENT = "note_path string, block_hash string, ord long, type string, result string"


def test_run_states_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(6)
    events = [(f"n{rng.randint(0, 3)}", f"h{rng.randint(0, 2)}", i, rng.choice(["run", "run", "save", "discard", "delete"] if rng.random() < 0.6 else ["run", "save"]), f"r{i}") for i in range(240)]
    got = {}

    def step(part):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        rows = run_states.settle_stream(spark.readStream.schema(EVENT).json(str(tmp_path / "in")))
        q = rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda b, _: got.update({(r["note_path"], r["block_hash"]): (r["saved"], r["pending"]) for r in b.collect()})).start().awaitTermination()

    for lo in range(0, 240, 80):  # a query of its own for each part goes on from the checkpoint
        step(events[lo : lo + 80])
    want = {(r["note_path"], r["block_hash"]): (r["saved"], r["pending"]) for r in runs.settle(spark.createDataFrame(events, EVENT)).collect()}
    assert {k: v for k, v in got.items() if v != (None, None)} == want


def test_output_until_the_terminal_event(spark, tmp_path):
    schema = "run_id string, ord long, type string, data string, code int, dur_ms long"
    rows = [("a", 1, "output", "x", None, None), ("b", 1, "output", "y", None, None), ("a", 2, "output", "z", None, None)], [("a", 3, "done", None, 0, 5), ("a", 4, "output", "late", None, None), ("c", 1, "done", None, 1, 2)], [("a", 5, "done", None, 9, 9), ("b", 2, "output", "w", None, None)]
    got = []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = run_states.complete_runs_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).start().awaitTermination()
    assert sorted(got) == [("a", "xz", 0, 5), ("c", "", 1, 2)]
    assert sorted(tuple(r) for r in changes.complete_runs(spark.createDataFrame(sum(rows, []), schema)).collect()) == sorted(got)
