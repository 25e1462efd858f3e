"""Folds over one text that a Column can't express in linear time: numbered units, packed lines, overlapping windows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

#: The line-leading numbering that opens a unit (circled number, number and dot, letter and dot).
MARKER = re.compile("(?m)^[ \t]*(?:([①-⑳㉑-㉟㊱-㊿])|([0-9]{1,3})\\.(?=[ \t])|([가나다라마바사아자차카타파하])\\.(?=[ \t]))")
#: Characters that packed lines aim at; characters of a window, its least before it may end at a line's end, and its overlap.
TARGET, SIZE, LEAST, OVERLAP = 600, 1800, 1000, 300

UNIT = "unit_key string, parent_key string, unit_type string, unit_number string, ordinal int, start_offset long, end_offset long, content string"
PACK = "chunk_index int, body string"
WINDOW = "chunk_index int, source_start long, source_end long, body string"


def units(text: str) -> Iterator[tuple]:
    """The root with the whole text, then spans that partition it: (key, parent, type, number, ordinal, start, end, content).

    A stack of the open levels gives parents: a paragraph closes what is open, an
    item hangs on the open paragraph or the root, a subitem on the open item. A
    subitem without an open item is plain text under the root. Offsets count code
    points; the contents after the root, joined, are the text.
    """
    yield "root", None, "article", "", 0, 0, len(text), text
    found = [(m.start(), m) for m in MARKER.finditer(text)]
    if not found or found[0][0] > 0:
        found.insert(0, (0, None))
    ends = [start for start, _ in found[1:]] + [len(text)]
    open_: list[tuple[str, str]] = []  # (level, key)
    for k, ((start, m), end) in enumerate(zip(found, ends, strict=True), 1):
        key, level, number, parent = f"u{k}", "text", "", "root"
        if m and m[1]:
            level, number = "paragraph", str(int(unicodedata.numeric(m[1])))
            open_ = [(level, key)]
        elif m and m[2]:
            open_ = [x for x in open_ if x[0] == "paragraph"]
            level, number, parent = "item", m[2], open_[-1][1] if open_ else "root"
            open_.append((level, key))
        elif m and open_ and open_[-1][0] == "item":
            level, number, parent = "subitem", m[3], open_[-1][1]
        yield key, parent, level, number, k, start, end, text[start:end]


def packed(text: str, target: int = TARGET) -> Iterator[tuple[int, str]]:
    """Stripped lines with text, packed in order: a chunk closes before the line that would take it past ``target`` characters.

    A longer line is a chunk of its own, never cut. A text without such lines is one chunk, stripped.
    """
    lines, size, k = [], 0, 0
    for line in filter(None, map(str.strip, text.splitlines())):
        if lines and size + len(line) > target:
            yield k, "\n".join(lines)
            lines, size, k = [], 0, k + 1
        lines.append(line)
        size += len(line)
    if lines or not k:
        yield k, "\n".join(lines) or text.strip()


def windows(text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, str]]:
    """Overlapping windows that cover a text: (index, start, end, body), none for an empty text.

    A window that does not reach the end breaks behind the last line end from
    ``least`` characters on, if it has one; the next starts ``overlap`` before.
    """
    start, k = 0, 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (line := text.rfind("\n", start + least, end)) >= 0:
            end = line + 1
        yield k, start, end, text[start:end]
        if end == len(text):
            return
        start, k = max(start + 1, end - overlap), k + 1
