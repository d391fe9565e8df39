"""Links and labels as output: links rewritten or flattened outside code, provenance lines, image chips."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vellum.functions.markdown import WIKILINK, text_lines

#: Beginning of a link to a note.
SCHEME = "note:"
_LINK, _SPAN = re.compile(WIKILINK), re.compile(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)")


def label_of(m: re.Match) -> str:
    """The alias, else the target with the heading it points into."""
    target, heading, alias = ((m[i] or "").strip() for i in (1, 2, 3))
    return alias or (f"{target} › {heading}" if heading else target)


def link_of(m: re.Match) -> str:
    """A Markdown link; target and heading are percent-encoded, so that # parts only the two."""
    heading = (m[2] or "").strip()
    part = "#" + quote(heading, safe="$&+:=@") if heading else ""
    return f"[{label_of(m)}]({SCHEME}{quote(m[1].strip(), safe='$&+:=@')}{part})"


def link_spans_of(text: str) -> list[re.Match]:
    """The links outside fences, indented code and code spans, in order."""
    if "[[" not in text:
        return []
    found, at = [], 0
    for line, code in text_lines(text.split("\n")):
        if not code and "[[" in line:
            spans = [m.span() for m in _SPAN.finditer(line)]
            starts = [0, *(e for _, e in spans)]
            for lo, hi in zip(starts, [*(s for s, _ in spans), len(line)]):
                found += _LINK.finditer(text, at + lo, at + hi)
        at += len(line) + 1
    return found


def outside_code(text: str, change: Callable[[re.Match], str]) -> str:
    """The text with every link outside code changed."""
    parts, at = [], 0
    for m in link_spans_of(text):
        parts += [text[at : m.start()], change(m)]
        at = m.end()
    return "".join([*parts, text[at:]])


def links_in(text: str) -> list[tuple[str, str, str]]:
    """(target, heading, label) of every link outside code, in order."""
    return [(m[1].strip(), m[2] or "", m[3] or "") for m in link_spans_of(text)]


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *(StructField(c, StringType()) for c in ("target", "heading", "label"))])


@F.pandas_udf(ArrayType(SPAN))
def link_spans(body: pd.Series) -> pd.Series:
    """Where each link outside code stands (code points from 0), and its trimmed parts."""
    return body.fillna("").map(lambda t: [(m.start(), m.end(), *((m[i] or "").strip() for i in (1, 2, 3))) for m in link_spans_of(t)])


@F.pandas_udf(StringType())
def splice(body: pd.Series, spans: pd.Series) -> pd.Series:
    """body with the parts that spans (start, end, text; sorted, apart from each other) name replaced; null: nothing to replace."""

    def one(text: str, found) -> str:
        parts, at = [], 0
        for s in () if found is None else found:
            parts += [text[at : s["start"]], s["text"]]
            at = s["end"]
        return "".join([*parts, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(body.fillna(""), spans)])


@F.pandas_udf(StringType())
def rewrite_links(body: pd.Series) -> pd.Series:
    """Wikilinks as Markdown links; code stays as it is; null: empty."""
    return body.fillna("").map(lambda t: outside_code(t, link_of))


@F.pandas_udf(StringType())
def flatten_links(body: pd.Series) -> pd.Series:
    """Wikilinks as the text they show; code stays as it is; null: empty."""
    return body.fillna("").map(lambda t: outside_code(t, label_of))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def folder_name(vault: Column) -> Column:
    return F.element_at(F.split(F.rtrim(vault, F.lit("/")), "/"), -1)


def source_label(vault: Column, path: Column, heading: Column) -> Column:
    """vault › path › heading, without the parts that are empty or null."""
    return F.concat_ws(" › ", _some(folder_name(vault)), path, _some(heading))


def chip_label(alt: Column, src: Column) -> Column:
    """What stands for an image in a hit: its alt text, else its source, else the word image."""
    return F.coalesce(_some(alt), _some(src), F.lit("image"))


@F.pandas_udf(ArrayType(IntegerType()))
def find_in_note(text: pd.Series, needle: pd.Series) -> pd.Series:
    """Starts (from 0) of all occurrences of needle that don't overlap, whatever the case; empty needle: none."""
    return pd.Series([[m.start() for m in re.finditer(re.escape(n), t, re.IGNORECASE)] if n else [] for t, n in zip(text.fillna(""), needle.fillna(""))])


def step_hit(at: Column, step: int, found: Column) -> Column:
    """The hit after (step 1) or before (step -1) hit number at, around the ends; null without hits."""
    return F.when(F.size(found) > 0, F.pmod(at + F.lit(step), F.size(found)))
