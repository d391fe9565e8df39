"""Word-processor files (DOCX, ODT) as block rows, and blocks as Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.listings import letter_ordinal

# Name spaces of the two formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
FO = "{urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0}"
DRAW = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
XLINK = "{http://www.w3.org/1999/xlink}"

BLOCKS = "doc string, ord int, heading int, list_level int, ordered boolean, alpha boolean, text string, error string"
IMAGES = "doc string, ord int, target string, name string, content binary, error string"
#: Folder of extracted images, level of a heading that is told by its bold type, its longest text, and twips of a list level.
ATTACHMENTS, BOLD_HEADING, HEADING_MOST, STEP = "attachments", 2, 50, 360
_MARKS = str.maketrans({c: "\\" + c for c in "\\*_[]`"})
_BULLET, _ORDINAL = re.compile(r"[•◦▪‣·–\-*][ \t](.*)", re.DOTALL), re.compile(r"(?:\d{1,3}|([a-z]))[.)][ \t](.*)", re.DOTALL)


def escaped(text: str) -> str:
    """text with the marks of inline Markdown taken literally; what leads a line isn't known here and stays."""
    return text.translate(_MARKS)


def emphasised(text: str, bold: bool, italic: bool) -> str:
    """text in its marks, with outer blanks outside them."""
    core = text.strip()
    if not core:
        return text
    lead = len(text) - len(text.lstrip())
    inner = f"**{core}**" if bold else core
    inner = f"_{inner}_" if italic else inner
    return text[:lead] + inner + text[lead + len(core) :]


def list_item(line: str) -> tuple[str, bool, bool] | None:
    """(text, ordered, lettered) of a line that draws its own list marker; an escaped bullet counts."""
    line = line.lstrip(" \t")
    for text in (line, line[1:] if line.startswith("\\") else ""):
        if m := _BULLET.match(text):
            return m[1].strip(), False, False
        if m := _ORDINAL.match(text):
            return m[2].strip(), True, m[1] is not None
    return None


@dataclass
class Paragraph:
    """What a paragraph's runs add up to: Markdown, its plain text, whether all of it is bold, its images."""

    markup: str = ""
    plain: str = ""
    bold: bool = True
    images: list[str] = field(default_factory=list)

    def blocks(self, heading: int, level: int, ordered: bool, styled: bool, indent: int) -> Iterator[tuple[int, int, bool, bool, str]]:
        """Blocks of a paragraph without a style are told by its text: lines with markers are items, a short bold line is a heading."""
        markup, plain = self.markup.rstrip(" \t"), self.plain.strip()
        if markup.strip():
            if not styled and list_item(plain):
                for line in markup.split("\n"):
                    text, is_ordered, lettered = list_item(line.strip()) or (line.strip(), False, False)
                    if text:
                        yield 0, max(indent // STEP, 1), is_ordered, lettered, text
            elif not styled and self.bold and len(plain.encode()) <= HEADING_MOST and not re.search(r"[\n:]|\.$", plain):
                yield BOLD_HEADING, 0, False, False, plain
            else:
                yield heading, level, ordered, False, markup.strip()
        for image in self.images:
            yield 0, 0, False, False, image


class ImageNames:
    """Names of a document's images in order of first reference; a name that is taken gets -2, -3 and so on."""

    def __init__(self) -> None:
        self.by_target: dict[str, str] = {}

    def name(self, target: str) -> str:
        if target not in self.by_target:
            base = target.rsplit("/", 1)[-1]
            stem, dot, ext = base.rpartition(".") if "." in base else (base, "", "")
            name, n, taken = base, 1, set(self.by_target.values())
            while name in taken:
                n += 1
                name = f"{stem}-{n}{dot}{ext}"
            self.by_target[target] = name
        return self.by_target[target]


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


def _ordered_lists(numbering: ET.Element | None) -> dict[tuple[str, int], bool]:
    """(numId, level) -> whether the level is numbered: numId's own override, else its abstractNum's level."""

    def levels(node: ET.Element) -> dict[int, bool]:
        out = {}
        for x in node.findall(f"{W}lvl"):
            form = x.find(f"{W}numFmt")
            out[int(x.get(f"{W}ilvl", "0"))] = form is not None and form.get(f"{W}val", "") not in ("", "bullet", "none")
        return out

    if numbering is None:
        return {}
    abstract = {a.get(f"{W}abstractNumId"): levels(a) for a in numbering.iter(f"{W}abstractNum")}
    found = {}
    for n in numbering.iter(f"{W}num"):
        of = n.find(f"{W}abstractNumId")
        mine = dict(abstract.get(of.get(f"{W}val"), {}) if of is not None else {})
        for o in n.findall(f"{W}lvlOverride"):
            mine |= levels(o)
        found |= {(n.get(f"{W}numId"), i): ordered for i, ordered in mine.items()}
    return found


def docx_blocks(raw: bytes, names: ImageNames) -> Iterator[tuple[int, int, bool, bool, str]]:
    """(heading level or 0, list level or 0, ordered, lettered, text) of the paragraphs, in order.

    The text of a box comes once, after the paragraph that holds it; of alternative contents the
    first is read. Images are blocks of their own after their paragraph.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        document, numbering, relations = (_xml(archive, f"word/{n}") for n in ("document.xml", "numbering.xml", "_rels/document.xml.rels"))
    if document is None:
        raise KeyError("word/document.xml")
    numbered = _ordered_lists(numbering)
    targets: dict[str, dict[str, str]] = {"hyperlink": {}, "image": {}}
    for r in relations if relations is not None else ():
        kind = (r.get("Type") or "/hyperlink").rsplit("/", 1)[-1]
        if r.get("Target") and kind in targets:
            targets[kind][r.get("Id")] = r.get("Target")

    def walk(node: ET.Element, into: Paragraph, inner: list[ET.Element]) -> None:
        """Adds the runs below node; paragraphs inside (text boxes) are put aside."""
        for x in node:
            if x.tag == f"{W}p":
                inner.append(x)
            elif x.tag in (f"{MC}Fallback", f"{W}pPr", f"{W}rPr"):
                continue
            elif x.tag == f"{W}hyperlink":
                part = Paragraph(bold=into.bold, images=into.images)
                walk(x, part, inner)
                target = targets["hyperlink"].get(x.get(f"{REL}id"))
                into.markup += f"[{part.markup}]({target})" if target and part.markup else part.markup
                into.plain, into.bold = into.plain + part.plain, part.bold
            elif x.tag == f"{W}r":
                style = x.find(f"{W}rPr")
                on = lambda t: style is not None and (e := style.find(f"{W}{t}")) is not None and e.get(f"{W}val") not in ("0", "false", "off")  # noqa: B023, E731
                bold, italic = on("b"), on("i")
                for e in x:
                    if e.tag == f"{W}t":
                        text = e.text or ""
                        into.bold = into.bold and (bold or not text.strip())
                        into.plain += text
                        into.markup += emphasised(escaped(text), bold, italic)
                    elif e.tag in (f"{W}tab", f"{W}br"):
                        into.plain += "\t" if e.tag == f"{W}tab" else "\n"
                        into.markup += "\t" if e.tag == f"{W}tab" else "  \n"
                    elif e.tag != f"{W}rPr":
                        walk(e, into, inner)
            elif x.tag.endswith("}blip"):
                target = targets["image"].get(x.get(f"{REL}embed"))
                if target:
                    into.images.append(f"![]({ATTACHMENTS}/{names.name(target)})")
                walk(x, into, inner)
            else:
                walk(x, into, inner)

    def paragraph(p: ET.Element) -> Iterator[tuple[int, int, bool, bool, str]]:
        style, number, ind = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}numPr"), p.find(f"{W}pPr/{W}ind")
        name = (style.get(f"{W}val") or "").lower() if style is not None else ""
        heading = 1 if name == "title" else 0
        if name.startswith("heading"):
            heading = min(max(int(name[7:]), 1), 6) if name[7:].lstrip("-").isdigit() else 1
        level, ordered = 0, False
        if number is not None:
            at, of = number.find(f"{W}ilvl"), number.find(f"{W}numId")
            depth = at.get(f"{W}val", "") if at is not None else ""
            level = 1 + (int(depth) if depth.isdigit() else 0)
            key = of.get(f"{W}val") if of is not None else None
            ordered = numbered.get((key, level - 1), numbered.get((key, 0), False))
        left = ind.get(f"{W}left", "") if ind is not None else ""
        into, inner = Paragraph(), []
        walk(p, into, inner)
        yield from into.blocks(heading, 0 if heading else level, ordered, heading > 0 or number is not None, int(left) if left.isdigit() else 0)
        for q in inner:
            yield from paragraph(q)

    def body(node: ET.Element) -> Iterator[tuple[int, int, bool, bool, str]]:
        for x in node:
            if x.tag == f"{W}p":
                yield from paragraph(x)
            elif x.tag != f"{MC}Fallback":
                yield from body(x)

    yield from body(document)


def odt_blocks(raw: bytes, names: ImageNames) -> Iterator[tuple[int, int, bool, bool, str]]:
    """The same for ODT: emphasis of nested spans adds up; lists keep their depth and kind."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        parts = [x for n in ("content.xml", "styles.xml") if (x := _xml(archive, n)) is not None]
    marks, ordered = {}, {}
    for part in parts:
        for s in part.iter(f"{STYLE}style"):
            t = s.find(f"{STYLE}text-properties")
            if t is not None:
                marks[s.get(f"{STYLE}name")] = (t.get(f"{FO}font-weight") == "bold", t.get(f"{FO}font-style") == "italic")
        for s in part.iter(f"{TEXT}list-style"):
            ordered[s.get(f"{STYLE}name")] = s.find(f"{TEXT}list-level-style-number") is not None

    def inline(node: ET.Element, bold: bool = False, italic: bool = False) -> str:
        out = [emphasised(escaped(node.text or ""), bold, italic)]
        for x in node:
            b, i = marks.get(x.get(f"{TEXT}style-name"), (False, False)) if x.tag == f"{TEXT}span" else (False, False)
            if x.tag == f"{TEXT}a":
                label = inline(x, bold, italic)
                out.append(f"[{label}]({x.get(f'{XLINK}href')})" if label.strip() else label)
            elif x.tag in (f"{TEXT}tab", f"{TEXT}line-break"):
                out.append("\t" if x.tag == f"{TEXT}tab" else "\n")
            elif x.tag == f"{TEXT}s":
                out.append(" " * int(x.get(f"{TEXT}c", "1")))
            else:
                out.append(inline(x, bold or b, italic or i))
            out.append(emphasised(escaped(x.tail or ""), bold, italic))
        return "".join(out)

    def walk(node: ET.Element, level: int, kind: bool) -> Iterator[tuple[int, int, bool, bool, str]]:
        for x in node:
            if x.tag == f"{TEXT}h":
                yield min(max(int(x.get(f"{TEXT}outline-level", "1")), 1), 6), 0, False, False, inline(x).strip()
            elif x.tag == f"{TEXT}p":
                into = Paragraph(inline(x), "".join(x.itertext()), bold=False)
                for image in x.iter(f"{DRAW}image"):
                    if image.get(f"{XLINK}href"):
                        into.images.append(f"![]({ATTACHMENTS}/{names.name(image.get(f'{XLINK}href'))})")
                yield from into.blocks(0, level, kind, level > 0, 0)
            elif x.tag == f"{TEXT}list":
                yield from walk(x, level + 1, ordered.get(x.get(f"{TEXT}style-name"), kind))
            else:
                yield from walk(x, level, kind)

    if parts:
        yield from walk(parts[0], 0, False)


def _parsed(path: str, raw: bytes) -> tuple[list[tuple[int, int, bool, bool, str]], ImageNames]:
    names = ImageNames()
    return [b for b in (odt_blocks if path.lower().endswith(".odt") else docx_blocks)(raw, names) if b[4]], names


_BAD = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError)


def blocks_of(files: DataFrame) -> DataFrame:
    """Block rows of files (path, content); a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i, *b, None) for i, b in enumerate(_parsed(path, bytes(raw))[0])]
                except _BAD as e:
                    rows.append((path, 0, 0, 0, False, False, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def images_of(files: DataFrame) -> DataFrame:
    """IMAGES: the images that the text refers to, in order, under the names that its links use; one that is missing has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    names = _parsed(path, bytes(raw))[1]
                    prefix = "" if path.lower().endswith(".odt") else "word/"
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as archive:
                        for i, (target, name) in enumerate(names.by_target.items()):
                            there = prefix + target in archive.namelist()
                            rows.append((path, i, target, name, archive.read(prefix + target) if there else None, None if there else "KeyError: no such entry"))
                except _BAD as e:
                    rows.append((path, 0, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, IMAGES)


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """doc, markdown of block rows (doc, ord, heading, list_level, ordered, alpha, text).

    Items of a list follow each other without a blank line, unless the marker changes at their level or above. Numbers count on over deeper items and
    start anew after another kind of block, a shallower item or a change of marker: windows tell
    the stretch, so no document is held as a whole until its lines are joined.
    """
    w = Window.partitionBy("doc").orderBy("ord")
    item = F.col("list_level") > 0
    rows = blocks.withColumn("_prev", F.lag("list_level").over(w)).withColumn("_other", F.lag("ordered").over(w) != F.col("ordered")).withColumn("_stretch", F.sum((~item).cast("int")).over(w))
    # An item starts its level anew where a shallower one has come since the last item of the level.
    levels = rows.groupBy("doc").agg(F.max("list_level").alias("_deep"))
    rows = rows.join(levels, "doc")
    shallower = F.when(item, F.col("ord")).otherwise(None)
    marks = rows.where(item).select("doc", "ord", "_stretch", "list_level", "ordered", F.explode(F.sequence("list_level", "_deep")).alias("_level"))
    one = Window.partitionBy("doc", "_stretch", "_level").orderBy("ord")
    cut = (F.col("list_level") < F.col("_level")) | (F.lag("ordered").over(one).isNotNull() & (F.lag("list_level").over(one) == F.col("_level")) & (F.lag("ordered").over(one) != F.col("ordered")))
    marks = marks.withColumn("_run", F.sum(cut.cast("int")).over(one)).where("list_level = _level")
    nth = F.row_number().over(Window.partitionBy("doc", "_stretch", "_level", "_run").orderBy("ord"))
    numbers = marks.select("doc", "ord", nth.alias("_nth"))
    rows = rows.join(numbers, ["doc", "ord"], "left")
    nth_text = F.when(F.col("alpha"), letter_ordinal(F.col("_nth"))).otherwise(F.col("_nth").cast("string"))
    mark = F.when(F.col("ordered"), F.concat(nth_text, F.lit(". "))).otherwise(F.lit("- "))
    line = F.when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), "text")).when(shallower.isNotNull(), F.concat(F.repeat(F.lit("  "), F.col("list_level") - 1), mark, "text")).otherwise(F.col("text"))
    together = item & (F.col("_prev") > 0) & ~((F.col("list_level") <= F.col("_prev")) & F.col("_other"))
    glue = F.when(F.col("_prev").isNull(), "").when(together, "\n").otherwise("\n\n")
    pieces = rows.select("doc", "ord", F.concat(glue, line).alias("s"))
    return pieces.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda r: r["s"]), "").alias("markdown"))
