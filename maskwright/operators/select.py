"""Choice among overlapping edits, and their application: in Python and as built-in functions."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Edit(NamedTuple):
    """A replacement of text[start:end]; ``index`` tells the rule, -1 a detection."""

    start: int
    end: int
    replacement: str
    kind: str
    index: int = -1
    priority: int = 0


class Apart:
    """Stretches, merged where they meet, that others are looked up among by binary search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def met(self, start: int, end: int) -> list[tuple[int, int]]:
        """Those that share a place with ``start`` to ``end``."""
        at = bisect_left(self.spans, (start,))
        if at and self.spans[at - 1][1] > start:
            at -= 1
        to = at
        while to < len(self.spans) and self.spans[to][0] < end:
            to += 1
        return self.spans[at:to]


class Choice(NamedTuple):
    """Edits that stay, in text order, and (loser, winner) pairs."""

    selected: list[Edit]
    lost: list[tuple[Edit, Edit]]


def choose(edits: Iterable[Edit]) -> Choice:
    """Greedy choice by priority, then length, then place, then rule.

    A loser's winner is the first chosen edit that it overlaps, in that order.
    """
    best: dict[tuple[int, int, int, str], Edit] = {}
    for e in edits:
        key = e.start, e.end, e.index, e.kind
        if key not in best or e.priority > best[key].priority:
            best[key] = e
    rank: dict[Edit, int] = {}
    taken: list[tuple[int, int, int, Edit]] = []  # apart, by start
    lost: list[tuple[Edit, Edit]] = []
    for e in sorted(best.values(), key=lambda e: (-e.priority, e.start - e.end, e.start, e.index)):
        at = bisect_left(taken, (e.start,))
        near = [t for t in taken[max(0, at - 1) : at] if t[1] > e.start]
        while at < len(taken) and taken[at][0] < e.end:
            near.append(taken[at])
            at += 1
        if near:
            lost.append((e, min(near, key=lambda t: t[2])[3]))
        else:
            insort(taken, (e.start, e.end, len(rank), e))
            rank[e] = len(rank)
    return Choice([t[3] for t in taken], lost)


def splice(text: str, edits: Sequence[Edit]) -> str:
    """``text`` with edits that are apart and in order."""
    out, at = [], 0
    for e in edits:
        out += [text[at : e.start], e.replacement]
        at = e.end
    return "".join([*out, text[at:]])


# ---- the same on columns: arrays of struct<start, end, replacement, kind, index, priority> ----

_ORDER = (
    "case when l.priority <> r.priority then sign(r.priority - l.priority) "
    "when l.end - l.start <> r.end - r.start then sign((r.end - r.start) - (l.end - l.start)) "
    "when l.start <> r.start then sign(l.start - r.start) else sign(l.index - r.index) end"
)


def choose_column(edits: str) -> Column:
    """The chosen edits of the array column ``edits``, in text order."""
    chosen = f"aggregate(array_sort({edits}, (l, r) -> cast({_ORDER} as int)), slice({edits}, 1, 0), (a, c) -> if(exists(a, x -> c.start < x.end and c.end > x.start), a, concat(a, array(c))))"
    return F.expr(f"array_sort({chosen}, (l, r) -> cast(sign(l.start - r.start) as int))")


def splice_column(text: str, edits: str) -> Column:
    """Text column with the chosen edits of an array column in text order applied."""
    folded = (
        f"aggregate({edits}, struct(cast('' as string) as done, 0 as at), "
        f"(a, e) -> struct(concat(a.done, substring({text}, a.at + 1, e.start - a.at), e.replacement) as done, cast(e.end as int) as at), "
        f"a -> concat(a.done, substring({text}, a.at + 1)))"
    )
    return F.expr(folded)
