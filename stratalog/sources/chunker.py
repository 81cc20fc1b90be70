"""Cutting documents into chunks along their headings.

Markdown is cut at headings of the first three levels; the breadcrumb of a chunk
names the document and the headings above it. Fences stay whole. A section of
few words joins the one before. Long sections are packed from paragraphs up to
a target, with an overlap of words; plain text is one flat section.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TARGET, MOST, LEAST, OVERLAP = 280, 400, 60, 40
CHUNK = "doc_id bigint, ord int, title string, body string, start_line int, end_line int"

_head = re.compile(r"(#{1,3})\s+(.*\S)\s*$")
_fence = re.compile(r"\s*(`{3,}|~{3,})")


def _words(lines: list[str]) -> int:
    return sum(len(x.split()) for x in lines)


def sections(lines: list[str], markdown: bool) -> Iterator[tuple[list[str], int, int]]:
    """(breadcrumb, first, end) of each section; ``end`` is exclusive."""
    crumb: list[str] = []
    begun, mark, now = 0, "", []
    for i, line in enumerate(lines):
        if (f := _fence.match(line)) and markdown:
            mark = "" if mark and f.group(1).startswith(mark) else mark or f.group(1)
        h = _head.match(line) if markdown and not mark else None
        if h:
            if i > begun:
                yield now, begun, i
            level = len(h.group(1))
            crumb = [*crumb[: level - 1], h.group(2)]
            now, begun = list(crumb), i
    if len(lines) > begun:
        yield now, begun, len(lines)


def units(lines: list[str], a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs and whole fences of a section as (first, end, fence)."""
    i = a
    while i < b:
        if f := _fence.match(lines[i]):
            j = i + 1
            while j < b and not ((g := _fence.match(lines[j])) and g.group(1).startswith(f.group(1))):
                j += 1
            yield i, min(j + 1, b), True
            i = j + 1
        elif not lines[i].strip():
            i += 1
        else:
            j = i
            while j < b and lines[j].strip() and not _fence.match(lines[j]):
                j += 1
            yield i, j, False
            i = j


def chunk_text(name: str, text: str, markdown: bool = True) -> list[tuple[str, str, int, int]]:
    """(title, body, first line, last line), lines from 1."""
    lines = re.split(r"\r\n|\r|\n", text)
    parts: list[list] = []
    for crumb, a, b in sections(lines, markdown):
        if not any(x.strip() for x in lines[a:b]):
            continue
        if parts and _words(lines[a:b]) < LEAST:
            parts[-1][2] = b
        else:
            parts.append([crumb, a, b])
    out = []
    for crumb, a, b in parts:
        title = " › ".join([name, *crumb])
        packed: list[list[int]] = []
        count, fence_last = 0, False
        for s, e, fence in units(lines, a, b):
            n = _words(lines[s:e])
            if packed and (count + n <= TARGET or n < LEAST and count + n <= MOST):
                packed[-1][1] = e
                count += n
            else:
                packed.append([s, e, not fence_last])
                count = n
            fence_last = fence
        if len(packed) > 1 and _words(lines[packed[-1][0] : packed[-1][1]]) < LEAST:
            tail = packed.pop()
            packed[-1][1] = tail[1]
        for k, (s, e, lap) in enumerate(packed):
            body = "\n".join(lines[s:e])
            if k and lap:
                before = " ".join("\n".join(lines[packed[k - 1][0] : packed[k - 1][1]]).split()[-OVERLAP:])
                body = f"{before}\n\n{body}"
            out.append((title, body, s + 1, e))
    return out


def chunk_documents(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, path, text. Null and blank texts have no chunks."""

    def run(frames):
        for f in frames:
            rows = []
            for doc, path, text in f.itertuples(index=False):
                if text and text.strip():
                    name = (path or "document").rsplit("/", 1)[-1]
                    rows += [(doc, k, *c) for k, c in enumerate(chunk_text(name, text, not (path or "").endswith((".txt", ".rst", ".toml"))))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "title", "body", "start_line", "end_line"])

    return docs.select("doc_id", "path", "text").mapInPandas(run, CHUNK)
