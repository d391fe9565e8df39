"""Markdown as Spark expressions, and small per-note scanners where order matters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

CODE_BLOCK = StructType().add("idx", IntegerType()).add("lang", StringType()).add("kernel", StringType()).add("version", StringType()).add("code", StringType())
PROPERTY = StructType().add("key", StringType()).add("values", ArrayType(StringType()))
CALLOUT = StructType().add("kind", StringType()).add("title", StringType()).add("icon", StringType()).add("depth", IntegerType()).add("text", StringType())

# A leading block between whole-line fences, and a link [[target#heading|label]].
FRONTMATTER = r"(?ms)\A---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\z)"
WIKILINK = r"\[\[([^\]\|#\n]+)(?:#([^\]\|\n]*))?(?:\|([^\]\n]*))?\]\]"
# Callout types and their icons.
CALLOUT_ICONS = {
    "note": "pencil", "info": "info-circle", "tip": "lightbulb", "hint": "lightbulb",
    "important": "exclamation-circle", "warning": "exclamation-triangle", "caution": "exclamation-triangle",
    "danger": "fire", "error": "x-octagon", "success": "check-circle", "check": "check-circle",
    "done": "check-circle", "question": "question-circle", "faq": "question-circle", "example": "list-ul",
    "quote": "chat-quote", "abstract": "card-text", "summary": "card-text", "bug": "bug",
}


def has_frontmatter(source: Column) -> Column:
    return source.rlike(FRONTMATTER)


def frontmatter_block(source: Column) -> Column:
    """The block's inside; null without one."""
    return F.when(has_frontmatter(source), F.regexp_extract(source, FRONTMATTER, 1))


def note_body(source: Column) -> Column:
    """The note after its leading block."""
    return F.when(has_frontmatter(source), F.substring(source, F.char_length(F.regexp_extract(source, FRONTMATTER, 0)) + 1, F.char_length(source))).otherwise(source)


def replace_body(source: Column, body: Column) -> Column:
    """A new body under the block that is there; a block that ends the note gets its line break first."""
    block = F.regexp_extract(source, FRONTMATTER, 0)
    ended = F.when(F.endswith(block, F.lit("\n")) | (body == ""), block).otherwise(F.concat(block, F.lit("\n")))
    return F.when(has_frontmatter(source), F.concat(ended, body)).otherwise(body)


def update_note(source: Column, content: Column) -> Column:
    """content with a block of its own replaces all, else only the body."""
    return F.when(has_frontmatter(content), content).otherwise(replace_body(source, content))


def note_title(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def block_hash(code: Column) -> Column:
    """Digest of a code block without one final line break."""
    return F.sha2(F.when(F.endswith(code, F.lit("\n")), F.substring(code, F.lit(1), F.char_length(code) - 1)).otherwise(code).cast("binary"), 256)


def html_headings(html: Column) -> Column:
    """h1 to h5 elements in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<h[1-5]\b[^>]*>.*?</h[1-5]>"), 0)


def embed_text(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded for a chunk: title, breadcrumb, blank line, text; empty parts left out."""
    head = F.array_join(F.filter(F.array(title, heading), lambda x: x != ""), "\n")
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^(#{1,6}) +(.*)$")


def fenced_lines(lines: list[str]):
    """(line, whether it is in or on a fence, info string where a fence opens) of each line."""
    mark = ""
    for line in lines:
        m = _FENCE.match(line)
        if not mark and m and not (m[1][0] == "`" and "`" in m[2]):
            mark = m[1]
            yield line, True, m[2].strip()
        elif mark:
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                mark = ""
            yield line, True, None
        else:
            yield line, False, None


_ITEM = re.compile(r"^([-*+]|\d{1,9}[.)])(?:( +)|$)")
_ALONE = re.compile(r"^(#{1,6}( |$)|([-*_] *){3,}$)")


def text_lines(lines: list[str]):
    """(line, whether it is code) of each line: fences, also in list items, and indented code.

    A line is indented code if it stands four columns or more in from the text of the open list item
    (from the margin without one) and doesn't go on with a paragraph.
    """
    items: list[int] = []
    mark, at, open_text = "", 0, False
    for line in lines:
        flat = line.expandtabs(4)
        rest = flat.lstrip(" ")
        indent = len(flat) - len(rest)
        if mark and (not rest or indent >= at):
            m = _FENCE.match(rest)
            if m and indent - at < 4 and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                mark = ""
            yield line, True
            continue
        mark = ""
        if not rest:
            open_text = False
            yield line, False
            continue
        goes_on = open_text and not _ITEM.match(rest)
        if not goes_on:
            while items and indent < items[-1]:
                items.pop()
        base = items[-1] if items else 0
        if indent - base >= 4 and not open_text:
            yield line, True
            continue
        while (m := _ITEM.match(rest)) and indent - (items[-1] if items else 0) < 4 and not re.match(r"^([-*_] *){3,}$", rest):
            while items and indent < items[-1]:
                items.pop()
            gap = len(m[2] or "")
            width = len(m[1]) + (gap if 0 < gap < 5 else 1)
            items.append(indent + width)
            rest = rest[len(m[1]) + (gap if gap < 5 else 1) :]
            indent += width
            if gap >= 5:
                break
        if rest.startswith("    "):  # an item that begins with indented code
            yield line, True
            continue
        m = _FENCE.match(rest)
        if m and not (m[1][0] == "`" and "`" in m[2]) and indent - (items[-1] if items else 0) < 4:
            mark, at, open_text = m[1], items[-1] if items else 0, False
            yield line, True
            continue
        open_text = bool(rest) and not _ALONE.match(rest)
        yield line, False


def code_blocks_of(body: str) -> list[dict]:
    """Fenced blocks with language, and kernel and version attributes of the info string."""
    out, current, opened = [], [], None
    for line, inside, info in fenced_lines(body.split("\n")):
        if info is not None:
            opened, current = info, []
        elif inside and opened is not None:
            if _FENCE.match(line) and line.strip().strip("`~") == "":
                out.append((opened, current))
                opened = None
            else:
                current.append(line)
    if opened is not None:
        out.append((opened, current))
    found = []
    for i, (info, lines) in enumerate(out):
        attribute = {k: v for k, v in re.findall(r'(\w+)="([^"]*)"', info)}
        lang = re.match(r"[^\s{]*", info)[0].lower()
        found.append({"idx": i, "lang": lang, "kernel": attribute.get("kernel", ""), "version": attribute.get("version", ""), "code": "\n".join(lines) + ("\n" if lines else "")})
    return found


@F.pandas_udf(ArrayType(CODE_BLOCK))
def code_blocks(body: pd.Series) -> pd.Series:
    return body.fillna("").map(code_blocks_of)


@F.pandas_udf(StringType())
def without_code(body: pd.Series) -> pd.Series:
    """The note with fenced blocks and code spans blanked, so that links in code don't count."""

    def blank(text: str) -> str:
        lines = ["" if code else line for line, code in text_lines(text.split("\n"))]
        return re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", "", "\n".join(lines))

    return body.fillna("").map(blank)


def wikilinks(body: Column) -> Column:
    """Links of a text without code, as structs of target, heading and label ('' where absent)."""
    whole = F.regexp_extract_all(body, F.lit(WIKILINK), 0)
    return F.transform(whole, lambda x: F.struct(F.trim(F.regexp_extract(x, WIKILINK, 1)).alias("target"), F.regexp_extract(x, WIKILINK, 2).alias("heading"), F.regexp_extract(x, WIKILINK, 3).alias("label")))


def first_heading_of(body: str) -> str | None:
    """Text of the first heading outside fences, however far they and it are indented; None without one."""
    fenced = False
    for line in body.split("\n"):
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(line)) and m[2].strip():
            return m[2].strip()
    return None


@F.pandas_udf(StringType())
def first_heading(body: pd.Series) -> pd.Series:
    """Text of the first heading outside code; null without one."""
    return body.fillna("").map(first_heading_of)


@F.pandas_udf(ArrayType(PROPERTY))
def properties(block: pd.Series) -> pd.Series:
    """Ordered properties of a leading block: scalars as written, sequences as several values."""
    import yaml

    def read(text: str) -> list[dict]:
        try:
            node = yaml.compose(text, Loader=yaml.SafeLoader)
        except yaml.YAMLError:
            return []
        if not isinstance(node, yaml.MappingNode):
            return []
        out = []
        for k, v in node.value:
            items = v.value if isinstance(v, yaml.SequenceNode) else [v]
            out.append({"key": str(k.value), "values": [x.value for x in items if isinstance(x, yaml.ScalarNode) and x.value != ""]})
        return out

    return block.fillna("").map(read)


@F.pandas_udf(StringType())
def properties_block(props: pd.Series) -> pd.Series:
    """A leading block's inside: one value as a scalar, several as a sequence, none as null; no properties: empty."""
    import yaml

    class Indented(yaml.SafeDumper):
        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    plain = yaml.SafeDumper("")

    def scalar(value: str) -> yaml.ScalarNode:
        return yaml.ScalarNode(plain.resolve(yaml.ScalarNode, value, (True, False)), value)

    def value_of(values: list[str]) -> yaml.Node:
        if len(values) == 1:
            return scalar(values[0])
        return yaml.SequenceNode("tag:yaml.org,2002:seq", [scalar(v) for v in values], flow_style=False) if len(values) else yaml.ScalarNode("tag:yaml.org,2002:null", "")

    def write(some) -> str:
        if some is None or not len(some):
            return ""
        pairs = [(scalar(p["key"]), value_of(p["values"])) for p in some]
        return yaml.serialize(yaml.MappingNode("tag:yaml.org,2002:map", pairs, flow_style=False), Dumper=Indented, indent=4, width=1 << 30, allow_unicode=True)

    return props.map(write, na_action=None)


def replace_properties(source: Column, props: Column) -> Column:
    """The note under a block of these properties (key, values); without any the block goes; the body stays as it is."""
    block = properties_block(props)
    return F.concat(F.when(block == "", "").otherwise(F.concat(F.lit("---\n"), block, F.lit("---\n"))), note_body(source))


def property_values(props: Column, *keys: str) -> Column:
    """Values of all properties with one of the keys, whatever the case of the key."""
    return F.flatten(F.transform(F.filter(props, lambda p: F.lower(p["key"]).isin(*keys)), lambda p: p["values"]))


def callouts_of(body: str) -> list[dict]:
    """Callouts among quoted lines; the title is the capitalised type where there is none."""
    out, inside_one, depth_of = [], False, re.compile(r"^\s*((?:>\s?)+)(.*)$")
    for line, inside, _ in fenced_lines(body.split("\n")):
        m = depth_of.match(line) if not inside else None
        head = re.match(r"\s*\[!([A-Za-z]+)\]([^\n]*)$", m[2]) if m else None
        if head:
            kind = head[1].lower()
            inside_one = True
            out.append({"kind": kind, "title": head[2].strip() or kind.capitalize(), "icon": CALLOUT_ICONS.get(kind, "info-circle"), "depth": m[1].count(">"), "text": ""})
        elif not m:
            inside_one = False  # later quotes are no part of it
        elif inside_one:
            out[-1]["text"] += ("\n" if out[-1]["text"] else "") + m[2]
    return out


@F.pandas_udf(ArrayType(CALLOUT))
def callouts(body: pd.Series) -> pd.Series:
    return body.fillna("").map(callouts_of)
