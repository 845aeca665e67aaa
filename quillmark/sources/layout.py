"""Blocks and elements of a page from its positioned runs: recursive XY-cut (Nagy and Seth 1984), reading order, element types.

A region is cut at its widest gap, measured by what gaps of its direction usually are: a white column that runs through
all of it and is wider than words are apart, or a white row that is higher than lines are apart. Parts are read from left
to right and from top to bottom; what can't be cut is a block, its lines joined in order. Types follow from size, place
and words: a line that stands at the same edge of three pages or more, numbers aside, is a header or footer; a block
in larger type is a title; one that begins with a bullet or number is a list item; one with a sentence is narrative text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from statistics import median

#: Widths of a white column in type sizes, of a white row in type sizes; how much larger a title's type is than the usual one.
COLUMN, ROW, TITLE = 1.2, 0.75, 1.15
#: Runs on one line differ in height by so many type sizes at most; a gap of so many is a space.
SAME_LINE, BLANK = 0.5, 0.15
_LIST = re.compile(r"^(?:[•–—*-]|\(?\d{1,3}[.)]|\[\d+\])\s+")


@dataclass
class Block:
    page: int
    x0: float
    y0: float
    y1: float
    size: float
    text: str
    kind: str = "UncategorizedText"


def _gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """The widest gap between spans, and its middle; 0 where they leave none."""
    best, end = (0.0, 0.0), None
    for a, b in sorted(spans):
        if end is not None and a - end > best[0]:
            best = (a - end, (a + end) / 2)
        end = b if end is None else max(end, b)
    return best


def _cut(runs: list, depth: int = 0) -> list[list]:
    """Groups of runs, in reading order."""
    if len(runs) < 2 or depth > 200:
        return [runs]
    size = median(r.size for r in runs) or 1.0
    wide, x = _gap([(r.x0, r.x1) for r in runs])
    high, y = _gap([(r.y - 0.25 * r.size, r.y + 0.8 * r.size) for r in runs])
    column, row = wide / size / COLUMN, high / size / ROW
    lines = len({round(r.y / size) for r in runs})
    if column >= 1 and lines > 1 and column >= row * 0.5:
        parts = [r for r in runs if r.x0 < x], [r for r in runs if r.x0 >= x]
    elif row >= 1:
        parts = [r for r in runs if r.y > y], [r for r in runs if r.y <= y]
    elif column >= 1 and lines > 1:
        parts = [r for r in runs if r.x0 < x], [r for r in runs if r.x0 >= x]
    else:
        return [runs]
    return [g for part in parts if part for g in _cut(part, depth + 1)]


def _joined(runs: list) -> str:
    """The lines of a block, a newline between them."""
    lines = []
    for r in sorted(runs, key=lambda r: (-r.y, r.x0)):
        if lines and abs(lines[-1][0].y - r.y) <= SAME_LINE * max(r.size, 1.0):
            lines[-1].append(r)
        else:
            lines.append([r])
    out = []
    for line in lines:
        text, end = "", None
        for r in sorted(line, key=lambda r: r.x0):
            apart = end is not None and r.x0 - end > BLANK * max(r.size, 1.0)
            text += (" " if apart and not text.endswith(" ") and not r.text.startswith(" ") else "") + r.text
            end = r.x1
        out.append(text.strip())
    return "\n".join(x for x in out if x)


def blocks(pages: list[list]) -> list[Block]:
    """The blocks of the runs of each page, in reading order, with their types."""
    found = []
    for number, runs in enumerate(pages, 1):
        for group in _cut([r for r in runs if r.text.strip()]):
            text = _joined(group)
            if text:
                found.append(Block(number, min(r.x0 for r in group), min(r.y for r in group), max(r.y for r in group), median(r.size for r in group), text))
    if not found:
        return found
    weight = Counter()
    for b in found:
        weight[round(b.size, 1)] += len(b.text)
    usual = max(weight, key=lambda s: (weight[s], -s))
    plain = lambda b: re.sub(r"\d+", "#", b.text)
    edges = Counter()
    for number in {b.page for b in found}:
        of = [b for b in found if b.page == number]
        for b in {id(x): x for x in (max(of, key=lambda b: b.y1), min(of, key=lambda b: b.y0))}.values():
            edges[plain(b), b is max(of, key=lambda b: b.y1)] += 1
    for b in found:
        of = [x for x in found if x.page == b.page]
        top, bottom = b is max(of, key=lambda x: x.y1), b is min(of, key=lambda x: x.y0)
        words = len(b.text.split())
        if top and edges[plain(b), True] >= 3:
            b.kind = "Header"
        elif bottom and edges[plain(b), False] >= 3 or re.fullmatch(r"\W*\d{1,4}\W*", b.text):
            b.kind = "Footer"
        elif b.size >= TITLE * usual and words <= 30:
            b.kind = "Title"
        elif _LIST.match(b.text):
            b.kind = "ListItem"
        elif words >= 5 and re.search(r"[.!?][\"'”’)\]]*(\s|$)", b.text):
            b.kind = "NarrativeText"
        elif words <= 8 and b.text[:1].isupper() and not re.search(r"[.,;:]$", b.text):
            b.kind = "Title"
    return found
