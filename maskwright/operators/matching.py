"""Replacement rules: smart, exact and fuzzy matches in texts and in positioned words."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from ..functions import text as X
from ..functions import vocabulary as V
from .select import Apart, Edit
from .structure import Structure


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    case_sensitive: bool = False
    smart: bool = True
    preserve_case: bool = True
    fuzzy_threshold: float = V.FUZZY_THRESHOLD

    def replacement(self, original: str) -> str:
        return X.with_case_of(original, self.target) if self.preserve_case else self.target

    def key(self, value: str) -> str:
        """Words of ``value`` as one string, for comparison."""
        return "".join(X.squeeze(w, self.case_sensitive) for w in X.words(value))


class Matcher:
    """A rule with its pattern and keys computed once."""

    def __init__(self, index: int, rule: Rule):
        self.index, self.rule = index, rule
        self.pattern = re.compile(X.rule_pattern(rule.source, rule.smart), 0 if rule.case_sensitive else re.I)
        self.source, self.target = rule.key(rule.source), rule.key(rule.target)
        self.window = min(8, max(1, len(X.words(rule.source)) + 3))
        self.known = dict.fromkeys(map(ord, self.source))
        self.longest = max(len(self.source) + 6, int(len(self.source) * 1.45))
        size = self._shared_run()
        self.runs = re.compile(f"(?=({'|'.join(sorted({re.escape(self.source[i : i + size]) for i in range(len(self.source) - size + 1)}))}))") if size else None
        self.run = size

    def _shared_run(self) -> int:
        """How many characters of the source in a row every window at the threshold has at least; 0 if no useful number.

        A ratio t of lengths a and b leaves at most (a + b)(1 - t) characters
        unmatched, and the matched ones fall into one block more at most.
        """
        size, t = len(self.source), self.rule.fuzzy_threshold
        least = size
        for length in range(1, self.longest + 1):
            if size and 2 * min(length, size) >= t * (length + size) - 1e-9:
                matched, free = t * (length + size) / 2, int((length + size) * (1 - t) + 1e-9)
                least = min(least, math.ceil(matched / (free + 1) - 1e-9))
        return least if least > 1 else 0

    def _starts(self, keys: list[str]) -> Iterable[int]:
        """Words at which a window can begin that has a run of the source."""
        if self.runs is None:
            return range(len(keys))
        places = list(accumulate(map(len, keys), initial=0))
        out: dict[int, None] = {}
        for m in self.runs.finditer("".join(keys)):
            to = bisect_right(places, m.start())
            out.update(dict.fromkeys(range(bisect_left(places, m.start() + self.run - self.longest), min(to, len(keys)))))
        return sorted(out)

    def _edit(self, text: str, start: int, end: int, priority: int) -> Edit:
        return Edit(start, end, self.rule.replacement(text[start:end]), "rule", self.index, priority)

    def exact(self, text: str) -> Iterator[Edit]:
        for m in self.pattern.finditer(text):
            if m.end() > m.start():
                yield self._edit(text, *m.span(), V.EXACT_PRIORITY)

    def _alike(self, text: str, structure: Structure) -> Iterator[tuple[float, int, int]]:
        """(ratio, start, end) of the word windows at or above the threshold."""
        rule, size = self.rule, len(self.source)
        spans = [m.span() for m in V.WORD.finditer(text)]
        keys = [text[a:b] for a, b in spans]
        if not rule.case_sensitive:
            keys = [k.casefold() for k in keys]
        # characters of a word that the source has at all bound what can match
        useful = lru_cache(None)(lambda key: len(key) - len(key.translate(self.known)))
        matcher = SequenceMatcher(None, "", self.source)
        for i in self._starts(keys):
            start = spans[i][0]
            length = shared = 0
            for j in range(i, min(len(spans), i + self.window)):
                length += len(keys[j])
                shared += useful(keys[j])
                if length > self.longest:
                    break
                if 2 * min(shared, size) < rule.fuzzy_threshold * (length + size) - 1e-9:
                    continue
                joined = "".join(keys[i : j + 1])
                if joined == self.target:
                    continue
                if structure.crosses(start, spans[j][1]):
                    break  # longer windows cross it as well
                matcher.set_seq1(joined)
                if matcher.quick_ratio() >= rule.fuzzy_threshold and (ratio := matcher.ratio()) >= rule.fuzzy_threshold:
                    yield ratio, start, spans[j][1]

    def fuzzy(self, text: str, structure: Structure | None = None) -> list[Edit]:
        """Windows that resemble the source; among overlapping ones the most similar, then shortest."""
        if self.rule.fuzzy_threshold <= 0 or len(self.source) < V.FUZZY_LEAST:
            return []
        taken: list[tuple[int, int]] = []  # apart, in order
        for _, start, end in sorted(self._alike(text, structure or Structure(text)), key=lambda s: (-s[0], s[2] - s[1], s[1])):
            at = bisect_left(taken, (start, end))
            if not (at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end):
                taken.insert(at, (start, end))
        return [self._edit(text, a, b, V.FUZZY_PRIORITY) for a, b in taken]


def rule_edits(text: str, matchers: Sequence[Matcher]) -> list[Edit]:
    """All rules' edits, but for those that would cut into an e-mail address."""
    structure = Structure(text)
    found = [e for m in matchers for e in (*m.exact(text), *m.fuzzy(text, structure))]
    mails = Apart(m.span() for m in V.EMAIL.finditer(text)) if "@" in text else Apart([])
    return [e for e in found if all(e.start <= a and b <= e.end for a, b in mails.met(e.start, e.end))]


class WordBox(NamedTuple):
    text: str
    left: float
    top: float
    right: float
    bottom: float
    confidence: float = 100.0


def box_groups(boxes: Sequence[WordBox], rule: Rule) -> list[list[int]]:
    """Runs of consecutive words that a rule matches, each word in one run at most, left to right."""
    wanted = rule.key(rule.source)
    if not wanted:
        return []
    keyed = [(i, key) for i, b in enumerate(boxes) if (key := X.squeeze(b.text, rule.case_sensitive))]
    longest = max(len(wanted) + 6, int(len(wanted) * 1.45))
    fuzzy = rule.fuzzy_threshold if rule.fuzzy_threshold > 0 else None
    groups: list[list[int]] = []
    at = 0
    while at < len(keyed):
        joined, taken = "", 0
        for k in range(at, len(keyed)):
            joined += keyed[k][1]
            alike = fuzzy is not None and len(wanted) >= V.FUZZY_LEAST and X.similarity_bound(len(joined), len(wanted)) >= fuzzy and X.similarity(joined, wanted) >= fuzzy
            if joined == wanted or alike:
                taken = k + 1 - at
                break
            if len(joined) > longest or (fuzzy is None and not wanted.startswith(joined)):
                break
        if taken:
            groups.append([i for i, _ in keyed[at : at + taken]])
        at += max(taken, 1)
    return groups
