"""HTML pages as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "main", "table", "ul", "ol", "blockquote", "pre", "figure", "form"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "code": "`"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.skip = 0
        self.pre = False
        self.cells: list[list[str]] | None = None

    def put(self, text: str) -> None:
        if self.cells is not None and self.cells and self.cells[-1]:
            self.cells[-1][-1] += text
        else:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.put("\n" if self.lists else "\n\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.put("\n" + "  " * max(len(self.lists) - 1, 0) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.put("[")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "br":
            self.put("  \n" if not self.pre else "\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "pre":
            self.pre = True
            self.put("\n\n```\n")
        elif tag in _MARKS and not (self.pre and tag == "code"):
            self.put(_MARKS[tag])
        elif tag == "table":
            self.cells = []
        elif tag == "tr" and self.cells is not None:
            self.cells.append([])
        elif tag in ("td", "th") and self.cells:
            self.cells[-1].append("")
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag in _BLOCKS:
            self.put("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("" if self.lists else "\n\n")
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag == "pre":
            self.pre = False
            self.put("\n```\n\n")
        elif tag in _MARKS and not (self.pre and tag == "code"):
            self.put(_MARKS[tag])
        elif tag == "table" and self.cells is not None:
            rows, self.cells = [r for r in self.cells if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join((c.strip().replace("\n", " ") for c in r + [""] * (width - len(r)))) + " |" for r in rows]
                self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        elif tag in _BLOCKS:
            self.put("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str) -> str:
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(writer.out))
    text = "\n".join(x if x.endswith("  ") else x.rstrip() for x in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """CommonMark with tables and strikethrough; unknown tags keep their text; empty stays empty."""
    return html.fillna("").map(markdown_of)
