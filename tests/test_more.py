"""Runs, registries, index passes and word-processor files on small literal inputs."""

import io
import zipfile

from pyspark.sql import functions as F

from vellum.operators import embedding, indexing, runs, vaults
from vellum.sources.word import blocks_of, blocks_to_markdown, images_of


def test_pending_and_saved_runs(spark):
    stories = {
        "first": ["run a"], "second": ["run a", "run b"], "saved": ["run a", "run b", "save"], "dropped": ["run a", "run b", "discard"],
        "replaced": ["run a", "run b", "run c", "save", "run d"], "deleted": ["run a", "run b", "delete"], "again": ["run a", "delete", "run b", "run c"],
        "idle": ["run a", "save", "discard", "save"], "lost": ["run a", "run b", "discard", "save"],
    }
    rows = [(n, "h", i, e.split()[0], (e.split() + [None])[1]) for n, es in stories.items() for i, e in enumerate(es)]
    events = spark.createDataFrame(rows, "note_path string, block_hash string, ord int, type string, result string")
    found = {r["note_path"]: (r["saved"], r["pending"]) for r in runs.settle(events).collect()}
    assert found == {"first": ("a", None), "second": ("a", "b"), "saved": ("b", None), "dropped": ("a", None), "replaced": ("c", "d"), "again": ("b", "c"), "idle": ("a", None), "lost": ("a", None)}


def test_run_above_stops_at_the_first_failure(spark):
    blocks = spark.createDataFrame([("n", i, lang) for i, lang in enumerate(["py", "text", "py", "py", "py"])], "note_path string, idx int, lang string")
    outcomes = spark.createDataFrame([("n", 0, 0), ("n", 2, 1)], "note_path string, idx int, exit_code int")
    states = runs.run_above(blocks, spark.createDataFrame([("py",)], "lang string"), outcomes, spark.createDataFrame([("n", 3)], "note_path string, idx int"))
    assert [r["state"] for r in states.orderBy("idx").collect()] == ["done", "skipped", "failed", "not run"]


def test_saved_results_come_back_and_orphans_go(spark):
    saved = spark.createDataFrame([("a", "1", 0), ("gone", "1", 0), ("unsure", "1", 0)], "note_path string, block_hash string, exit_code int")
    blocks = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2")], "note_path string, idx int, block_hash string")
    assert {r["idx"]: r["exit_code"] for r in runs.rehydrate(blocks, saved).collect()} == {0: 0, 1: None}
    notes, unsure = spark.createDataFrame([("a",)], "note_path string"), spark.createDataFrame([("unsure",)], "note_path string")
    assert {r["note_path"] for r in runs.sweep_orphans(saved, notes, unsure).collect()} == {"a", "unsure"}
    assert {r["note_path"] for r in runs.sweep_orphans(saved, notes).collect()} == {"a"}


def test_vault_registry(spark):
    recorded = spark.createDataFrame([(1, "/v/One"), (2, "/v/two")], "ord long, path string")
    added = spark.createDataFrame([(1, "/v/./One/"), (2, "/v/three"), (3, "  ")], "ord long, path string")
    rows = vaults.register(recorded, added)
    assert [r["path"] for r in rows.orderBy("ord").collect()] == ["/v/One", "/v/two", "/v/three"]
    left, last = vaults.forget(rows, spark.createDataFrame([("/v/three/",)], "path string"))
    assert left.count() == 2 and last.first()["last"] == "/v/two"
    known = spark.createDataFrame([("/v/one", True), ("/v/two", False), ("/v/x", True)], "path string, available boolean")
    live = spark.createDataFrame([("/v/One",)], "path string")
    assert {r["path"] for r in vaults.search_targets(live, known, case_sensitive=False).collect()} == {"/v/One", "/v/x"}


def test_packages(spark):
    rows = [("py", "1.9", ["any"]), ("py", "1.10", ["any"]), ("py", "2.0", ["linux"]), ("go", "1.0", ["any"]), ("go", "1.1", ["any"])]
    packages = spark.createDataFrame(rows, "family string, version string, artifacts array<string>")
    pins = spark.createDataFrame([("go", "1.0")], "family string, pin string")
    assert [tuple(r) for r in vaults.newest_installable(packages, pins).collect()] == [("py", "1.10")]
    have = spark.createDataFrame([("py", "1.9")], "family string, version string")
    assert vaults.package_catalogue(packages, have).where("installed").count() == 1


def test_settings_and_attachments(spark):
    schema = "key string, value string, updated_at long"
    rows = vaults.adopt_settings(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema), spark.createDataFrame([("a", "2", 5)], schema))
    assert {r["key"]: r["value"] for r in rows.collect()} == {"a": "2", "b": "1"}
    files = "name string, content binary"
    have = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"1"))], files)
    new = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2")), ("z", bytearray(b"3"))], files)
    assert {r["name"]: r["outcome"] for r in vaults.attachments(have, new).collect()} == {"x": "same", "y": "conflict", "z": "new"}


INDEX = "path string, idx int, heading string, text string, doc_hash string, embedding array<float>"


def disk(spark, notes):
    return spark.createDataFrame(list(notes.items()), "path string, body string").withColumn("doc_hash", F.sha2(F.col("body").cast("binary"), 256))


def test_an_index_pass(spark, tmp_path):
    embed = embedding.hashing_embedder(8)
    empty = spark.createDataFrame([], INDEX)
    one = indexing.sync_notes(disk(spark, {"a.md": "---\ntags: [x, y]\n---\n# T\nhello", "b.md": "world", "void.md": ""}), empty, embed)
    assert tuple(one.stats.first()) == (3, 0, 0, 0)
    path = indexing.write_index(one.chunks, str(tmp_path), "some-model", "v", "1")
    index = spark.read.parquet(path)
    rows = {r["path"]: r for r in index.collect()}
    assert rows["a.md"]["text"] == "x y\n\nhello" and rows["a.md"]["heading"] == "T" and len(rows["a.md"]["embedding"]) == 8 and "void.md" not in rows

    def poisoned(some):
        if any("poison" in t for t in some):
            raise ValueError("bad text")
        return embed(some)

    two = indexing.sync_notes(disk(spark, {"a.md": "poison", "b.md": "world", "c.md": "of the same batch"}).coalesce(1), index, poisoned, concurrency=1)
    assert tuple(two.stats.first()) == (1, 1, 0, 1) and two.errors.first()["sample"].startswith("a.md: ValueError")
    assert {r["path"]: r["text"] for r in two.chunks.collect()} == {"a.md": "x y\n\nhello", "b.md": "world", "c.md": "of the same batch"}
    three = indexing.sync_notes(disk(spark, {"b.md": "changed"}), index, embed)
    assert tuple(three.stats.first()) == (1, 0, 1, 0) and [r["text"] for r in three.chunks.collect()] == ["changed"]
    only = indexing.sync_notes(disk(spark, {"b.md": "changed"}), index, embed, only=spark.createDataFrame([("b.md",)], "path string"))
    assert {r["path"]: r["text"] for r in only.chunks.collect()} == {"a.md": "x y\n\nhello", "b.md": "changed"}
    assert tuple(indexing.sync_notes(disk(spark, {"b.md": "world", "a.md": "n"}), index, embed, force=True).stats.first()) == (2, 0, 0, 0)


WORDS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def docx(body):
    numbering = f'<w:numbering {WORDS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    relations = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="http://u"/></Relationships>'
    return zipped({"word/document.xml": f"<w:document {WORDS}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering, "word/_rels/document.xml.rels": relations})


def item(text, level, number):
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_word_files(spark):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>see </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><mc:AlternateContent><mc:Fallback><w:r><w:t>twice</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>'
    body += item("one", 0, 5) + item("deep", 1, 9) + item("two", 0, 5) + "<w:p><w:r><w:t>text</w:t></w:r></w:p>" + item("anew", 0, 5)
    odt = zipped({"content.xml": '<o:c xmlns:o="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"><style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style><text:h text:outline-level="9">H</text:h><text:p>a <text:span text:style-name="B">b</text:span></text:p><text:list><text:list-item><text:p>x</text:p><text:list><text:list-item><text:p>y</text:p></text:list-item></text:list></text:list-item></text:list></o:c>'})
    files = spark.createDataFrame([("a.docx", docx(body)), ("b.odt", odt), ("bad.docx", bytearray(b"junk"))], "path string, content binary")
    blocks = blocks_of(files).cache()
    assert [r["doc"] for r in blocks.where("error is not null").collect()] == ["bad.docx"]
    found = {r["doc"]: r["markdown"] for r in blocks_to_markdown(blocks.where("error is null").drop("error")).collect()}
    assert found["a.docx"] == "## Top\n\nsee **bold** [link](http://u)\n\n1. one\n  - deep\n\n2. two\n\ntext\n\n1. anew"
    assert found["b.odt"] == "###### H\n\na **b**\n\n- x\n  - y"


def run(text, *marks):
    style = "".join(f"<w:{m}/>" for m in marks)
    return f'<w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def para(inner, style=""):
    return f"<w:p><w:pPr>{style}</w:pPr>{inner}</w:p>"


def picture(rel):
    return f'<w:r><w:drawing><a:blip xmlns:a="a" r:embed="{rel}"/></w:drawing></w:r>'


def test_word_walk(spark):
    levels = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>'
    numbering = f'<w:numbering {WORDS}>{levels}<w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl></w:lvlOverride></w:num></w:numbering>'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    images = "".join(f'<Relationship Id="{i}" Type="{kinds}/image" Target="{t}"/>' for i, t in (("p1", "media/p.png"), ("p2", "media2/p.png"), ("p3", "media/p-2.png"), ("p4", "media/none.png")))
    relations = f'<Relationships xmlns="x">{images}<Relationship Id="r1" Type="{kinds}/hyperlink" Target="http://u"/></Relationships>'
    box = f"<mc:AlternateContent><mc:Choice><w:pict><w:txbxContent>{para(run('in a box'))}</w:txbxContent></w:pict></mc:Choice><mc:Fallback>{para(run('in a box'))}</mc:Fallback></mc:AlternateContent>"
    cell = lambda t: f"<w:tc>{para(run(t))}</w:tc>"
    body = [
        para(run("Short and bold", "b")), para(run("Label: bold", "b")), para(run("a*b_c [d] `e` \\", "i") + run(" both ", "b", "i")),
        para('<w:hyperlink r:id="r1">' + run("two ") + run("runs", "b") + "</w:hyperlink>" + picture("p1") + picture("p2") + picture("p1") + picture("p3")),
        para(f"<w:r>{box}</w:r>" + run("outside")), item("dot", 0, 5), item("one", 1, 5), item("two", 1, 5), item("roman", 0, 6),
        para(run("1) first") + "<w:r><w:br/></w:r>" + run("2) second"), '<w:ind w:left="720"/>'), para(run("a. lettered")), para(run("b. again")), para(run("* star")), para(run("1990s were"), '<w:tabs><w:tab w:val="left"/></w:tabs>'),
        f"<w:tbl><w:tr>{cell('c1')}{cell('c2')}</w:tr></w:tbl>", para(picture("p4")), para(run("deep"), '<w:pStyle w:val="heading9"/>'), para(run("  ")),
    ]
    raw = zipped({"word/document.xml": f"<w:document {WORDS}><w:body>{''.join(body)}</w:body></w:document>", "word/numbering.xml": numbering, "word/_rels/document.xml.rels": relations, "word/media/p.png": "1", "word/media2/p.png": "2", "word/media/p-2.png": "3"})
    files = spark.createDataFrame([("a.docx", raw), ("none.docx", zipped({"x": "y"}))], "path string, content binary")
    blocks = blocks_of(files)
    assert [r["doc"] for r in blocks.where("error is not null").collect()] == ["none.docx"]
    (row,) = blocks_to_markdown(blocks.where("error is null").drop("error")).collect()
    assert row["markdown"].split("\n\n") == [
        "## Short and bold", "**Label: bold**", "_a\\*b\\_c \\[d\\] \\`e\\` \\\\_ _**both**_", "[two **runs**](http://u)", "![](attachments/p.png)", "![](attachments/p-2.png)", "![](attachments/p.png)", "![](attachments/p-2-2.png)",
        "outside", "in a box", "- dot\n  1. one\n  2. two\n1. roman\n  1. first\n  2. second\nb. lettered\nc. again", "- star", "1990s were", "c1", "c2", "![](attachments/none.png)", "###### deep",
    ]
    found = {r["name"]: (bytes(r["content"]) if r["content"] else None, r["error"]) for r in images_of(files.where("path = 'a.docx'")).collect()}
    assert found == {"p.png": (b"1", None), "p-2.png": (b"2", None), "p-2-2.png": (b"3", None), "none.png": (None, "KeyError: no such entry")}
