"""Heading-aware chunks of notes, within a number of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from vellum.functions.markdown import _HEADING
from vellum.schema import ChunkOptions

#: What starts and ends a fence.
FENCES = ("```", "~~~")


def sections(body: str) -> Iterator[tuple[str, str]]:
    """(breadcrumb, text) between headings; a line that starts with the opening fence's mark closes it."""
    trail: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""
    for line in body.split("\n"):
        bare = line.strip()
        mark = bare[:3] if bare[:3] in FENCES else ""
        m = None if fence or mark else _HEADING.match(bare)
        if mark and fence in ("", mark):
            fence = "" if fence else mark
        if not m:
            lines.append(line.removesuffix("\r"))
            continue
        yield " › ".join(t for _, t in trail), "\n".join(lines).strip()
        level, lines = len(m[1]), []
        trail = [x for x in trail if x[0] < level] + [(level, m[2].strip())]
    yield " › ".join(t for _, t in trail), "\n".join(lines).strip()


def hard_cut(raw: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most size bytes that end between characters; at least one character each."""
    while raw:
        end = min(size, len(raw))
        while 0 < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end <= 0:  # the budget is less than a character
            end = 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        yield raw[:end]
        raw = raw[end:]


def tail(raw: bytes, overlap: int) -> bytes:
    """The last bytes, from a character's start, then from after the first blank unless that is all; a short window as a whole."""
    if overlap <= 0:
        return b""
    if len(raw) <= overlap:
        return raw.strip()
    cut = raw[-overlap:]
    while cut and cut[0] & 0xC0 == 0x80:
        cut = cut[1:]
    blanks = [i for i in (cut.find(b" "), cut.find(b"\n")) if i >= 0]
    return (cut[min(blanks) + 1 :] if blanks and min(blanks) < len(cut) - 1 else cut).strip()


def windows(text: str, options: ChunkOptions) -> Iterator[str]:
    """Paragraphs packed into windows of at most size bytes, each starting with the end of the one before.

    A paragraph beyond the size is cut into windows of its own.
    """
    size, overlap = options.size, options.overlap
    if len(text.encode()) <= size:
        yield text
        return
    held = b""
    for paragraph in text.split("\n\n"):
        raw = paragraph.strip().encode()
        if not raw:
            continue
        if len(raw) > size:
            yield from (x.decode() for x in (held, *hard_cut(raw, size)) if x)
            held = b""
            continue
        if held and len(held) + 2 + len(raw) > size:
            yield held.decode()
            held = tail(held, overlap)
            if len(held) + 2 + len(raw) > size:
                held = b""
        held = held + b"\n\n" + raw if held else raw
    if held.strip():
        yield held.decode()


def chunks_of(body: str, options: ChunkOptions) -> list[tuple[str, str]]:
    return [(crumb, w) for crumb, text in sections(body) if text for w in windows(text, options) if w.strip()]


def chunk_notes(notes: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """path, idx, heading, text of every note's chunks (notes: path, body)."""
    options = (options or ChunkOptions()).settled()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, h, t) for p, b in zip(batch["path"], batch["body"]) for i, (h, t) in enumerate(chunks_of(b or "", options))]
            yield pd.DataFrame(rows, columns=["path", "idx", "heading", "text"])

    return notes.select("path", "body").mapInPandas(run, "path string, idx int, heading string, text string")
