"""Markdown bodies as passages with their sections: lines are named one by one, then read with one line of lookahead."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

# The most characters of a passage, and those under which it is joined to the next one.
PASSAGE_CHARS, MERGE_BELOW = 1200, 200
# Fixed value: between the headings of a section.
BETWEEN = " > "

BLANK, BREAK, TEXT, FENCE, HEADING = "blank", "break", "text", "fence", "heading"


class Line(NamedTuple):
    kind: str
    level: int = 0
    value: str = ""


class Passage(NamedTuple):
    start: int
    end: int
    line_start: int
    line_end: int
    section: str


def name_line(line: str) -> Line:
    """What a line is by itself."""
    if not line.strip():
        return Line(BLANK)
    body = line.lstrip(" ")
    if len(line) - len(body) > 3:
        return Line(TEXT)
    sign = body[0]
    run = len(body) - len(body.lstrip(sign))
    if sign in "`~" and run >= 3:
        return Line(FENCE, run, sign)
    if sign == "#" and run <= 6 and body[run : run + 1] in ("", " ", "\t"):
        return Line(HEADING, run, _title(body[run:]))
    if sign in "-*_":
        dense = body.replace(" ", "").replace("\t", "")
        if len(dense) >= 3 and dense == sign * len(dense):
            return Line(BREAK)
    return Line(TEXT)


def _title(rest: str) -> str:
    """A heading's text without signs that close it, which stand apart."""
    rest = rest.strip(" \t")
    bare = rest.rstrip("#")
    return (bare if not bare or bare[-1] in " \t" else rest).strip()


def underline(line: str) -> int:
    """The level that a line of = or - gives the line above it, or 0."""
    body = line.lstrip(" ")
    core = body.rstrip(" \t")
    if not core or len(line) - len(body) > 3 or core != core[0] * len(core):
        return 0
    return {"=": 1, "-": 2}.get(core[0], 0)


def is_item(line: str) -> bool:
    """Whether a list item starts here."""
    body = line.lstrip(" ")
    number = len(body) - len(body.lstrip("0123456789"))
    width = 1 if body[:1] in ("-", "*", "+") else number + 1 if 1 <= number <= 9 and body[number : number + 1] in (".", ")") else 0
    return bool(width) and len(line) - len(body) <= 3 and body[width : width + 1] in ("", " ", "\t", "\n")


def outline(lines: list[str]) -> Iterator[tuple[int, int, Line | None]]:
    """(first line, last line, heading or None for a block) in order."""
    named = [name_line(x) for x in lines]
    at, n = 0, len(lines)
    while at < n:
        here, to = named[at], at + 1
        if here.kind == FENCE:
            while to < n and not _closes(lines[to], here):
                to += 1
            to = min(to + 1, n)
            yield at, to - 1, None
        elif here.kind == HEADING:
            yield at, at, here
        elif here.kind == TEXT:
            level = underline(lines[to]) if to < n else 0
            if level and not is_item(lines[at]) and not lines[at].lstrip().startswith(">"):
                to += 1
                yield at, at, Line(HEADING, level, lines[at].strip())
            else:
                while to < n and named[to].kind == TEXT:
                    to += 1
                yield at, to - 1, None
        at = to


def _closes(line: str, fence: Line) -> bool:
    core = line.strip()
    return len(core) >= fence.level and core == fence.value * len(core) and len(line) - len(line.lstrip(" ")) <= 3


def inner(text: str, a: int, b: int) -> tuple[int, int] | None:
    """[a, b) without the space at its ends; None if nothing is left."""
    part = text[a:b] if a < b else ""
    core = part.strip()
    if not core:
        return None
    low = a + part.index(core)
    return low, low + len(core)


def _item_starts(text: str, a: int, b: int) -> Iterable[int]:
    return (at for at in _line_starts(text, a, b) if is_item(text[at : min(at + 16, b)]))


def _line_starts(text: str, a: int, b: int) -> Iterable[int]:
    return (m.end() for m in re.compile("\n").finditer(text, a, b))


def _sentence_starts(text: str, a: int, b: int) -> Iterable[int]:
    return (m.end() for m in re.compile("[.!?][ \t]+").finditer(text, a, b))


def _word_starts(text: str, a: int, b: int) -> Iterable[int]:
    return (m.end() for m in re.compile(r"\s+").finditer(text, a, b))


#: Where a passage that is too long may be cut, the best places first.
_PLACES = (_item_starts, _line_starts, _sentence_starts, _word_starts)


def fitted(text: str, a: int, b: int, most: int, places: tuple = _PLACES) -> list[tuple[int, int]]:
    """[a, b) in parts of at most most characters: cut at the first kind of place that there is, parts cut on if need be, and neighbours joined while they fit."""
    if b - a <= most:
        return [(a, b)]
    if not places:
        return [(i, min(i + most, b)) for i in range(a, b, most)]
    edges = [a, *places[0](text, a, b), b]
    parts = [p for p in map(lambda lo, hi: inner(text, lo, hi), edges[:-1], edges[1:]) if p]
    if len(parts) == 1:
        return fitted(text, a, b, most, places[1:])
    out: list[tuple[int, int]] = []
    for part in parts:
        for lo, hi in fitted(text, *part, most, places[1:]):
            if out and hi - out[-1][0] <= most:
                lo = out.pop()[0]
            out.append((lo, hi))
    return out


class Markdown:
    """A body's passages, and the section at each place. A first heading of level 1 is the body's title and no section."""

    def __init__(self, text: str, first_line: int = 1, most: int = PASSAGE_CHARS, merge_below: int = MERGE_BELOW) -> None:
        lines = text.split("\n")
        self.text, self.first_line = text, first_line
        self.line_starts = [0]
        for x in lines[:-1]:
            self.line_starts.append(self.line_starts[-1] + len(x) + 1)
        #: Section names, and the offsets of the headings from which all but the first name hold.
        self.names, self.holds_from = [""], []
        path: dict[int, str] = {}
        spans: list[list] = []
        for first, last, heading in outline(lines):
            low, high = self.line_starts[first], self.line_starts[last] + len(lines[last])
            if heading:
                if self.holds_from or heading.level > 1:
                    path = {k: v for k, v in path.items() if k < heading.level} | {heading.level: heading.value}
                self.holds_from.append(low)
                self.names.append(BETWEEN.join(path.values()))
                continue
            for a, b in fitted(text, *inner(text, low, high), most):
                before = spans[-1] if spans else None
                if before and before[2] == self.names[-1] and before[1] - before[0] < merge_below and b - before[0] <= most and text[before[1] : a].isspace():
                    before[1] = b
                else:
                    spans.append([a, b, self.names[-1]])
        self.passages = [self._passage(a, b, section) for a, b, section in spans]

    def _passage(self, a: int, b: int, section: str, origin: int = 0) -> Passage:
        return Passage(a - origin, b - origin, self.line_of(a), self.line_of(b - 1), section)

    def line_of(self, offset: int) -> int:
        return self.first_line + bisect_right(self.line_starts, offset) - 1

    def section_at(self, offset: int) -> str:
        """The section that holds for text at offset: that of the last heading before it."""
        return self.names[bisect_left(self.holds_from, offset)]

    def clip(self, start: int, end: int) -> list[Passage]:
        """What of the passages lies in [start, end); offsets count from start."""
        within = ((inner(self.text, max(p.start, start), min(p.end, end)), p.section) for p in self.passages)
        return [self._passage(*span, section, start) for span, section in within if span]
