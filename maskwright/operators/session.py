"""Anonymization of one document, unit after unit.

A session keeps what spans the units of a document: the placeholders given so
far, and the counts.  It is a plain object inside one task; every result is a
function of the document's units in their order, so retries change nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

from ..functions import text as X
from ..functions import vocabulary as V
from .detect import Detection, detect
from .matching import Matcher, Rule, rule_edits
from .select import Apart, Edit, choose, splice
from .structure import visible


class Suggestion(NamedTuple):
    kind: str
    value: str
    target: str
    reason: str
    confidence: float = 0.0
    source: str = "deterministic"


def suggestion(d: Detection, target: str | None = None) -> Suggestion:
    return Suggestion(d.kind, d.value, target or X.first_placeholder(d.placeholder_kind), d.reason, d.confidence, d.source)


def merge_suggestions(*groups: Iterable[Suggestion], most: int = V.MOST_SUGGESTIONS) -> list[Suggestion]:
    """The first of each (kind, value), in order, up to ``most``."""
    out: dict[tuple[str, str], Suggestion] = {}
    for s in (s for group in groups for s in group):
        if len(out) >= most:
            break
        out.setdefault((s.kind, X.canonical(s.kind, s.value)), s)
    return list(out.values())


def residual(text: str, most: int = V.MOST_SUGGESTIONS) -> list[Suggestion]:
    """What the detectors still find in an output text."""
    return merge_suggestions(map(suggestion, detect(text)), most=most)


class Ner(NamedTuple):
    """A named-entity model: a callable from text to (label, start, end, score or None)."""

    model: Callable[[str], Iterable[tuple[str, int, int, float | None]]]
    threshold: float = 0.85
    suggest_only: bool = False

    def detect(self, text: str) -> list[Detection]:
        out = []
        for label, start, end, score in self.model(text):
            value, label = text[start:end].strip(), label.upper()
            if start < 0 or not value or X.is_safe(label, value):
                continue
            kind = V.NER_LABELS.get(label, "value")
            # a model without scores is not trusted to rewrite
            out.append(Detection(kind, value, start, end, max(0.0, min(1.0, float(score or 0.0))), f"local NER {label or 'unknown'}", X.prefix_of(kind), True, "spacy"))
        return out


class _Origin:
    """Where the current text came from: what was put in, as (start, end, first, last) with the source's stretch."""

    def __init__(self) -> None:
        self.put: list[tuple[int, int, int, int]] = []

    def _place(self, at: int) -> tuple[int, int]:
        """The source's stretch of one character."""
        i = bisect_right(self.put, (at, math.inf)) - 1
        if i < 0:
            return at, at + 1
        _, end, first, last = self.put[i]
        return (first, last) if at < end else (at - end + last, at - end + last + 1)

    def of(self, e: Edit) -> tuple[int, int] | None:
        if not self.put and e.end > e.start:
            return e.start, e.end
        return (self._place(e.start)[0], self._place(e.end - 1)[1]) if e.end > e.start else None

    def advance(self, edits: Sequence[Edit]) -> None:
        """Edits in order; earlier ones that they cover are part of their stretch."""
        new: list[tuple[int, int, int, int]] = []
        shift, old = 0, iter([*self.put, (math.inf, math.inf, 0, 0)])
        held = next(old)
        for e in edits:
            while held[0] < e.start:
                new.append((held[0] + shift, held[1] + shift, *held[2:]))
                held = next(old)
            while held[0] < e.end:
                held = next(old)
            new.append((e.start + shift, e.start + shift + len(e.replacement), *self.of(e)))
            shift += len(e.replacement) - (e.end - e.start)
        while held[0] != math.inf:
            new.append((held[0] + shift, held[1] + shift, *held[2:]))
            held = next(old)
        self.put = new


@lru_cache(64)
def _matchers(rules: tuple[Rule, ...]) -> list[Matcher]:
    """Matchers hold nothing of a document; those of equal rules are made once in a process."""
    return [Matcher(i, r) for i, r in enumerate(rules)]


class Session:
    def __init__(self, rules: Iterable[Rule] = (), ner: Ner | None = None, detect_values: bool = True, safe_domains: tuple[str, ...] = V.SAFE_DOMAINS):
        self.matchers = _matchers(tuple(rules))
        self.rules = [m.rule for m in self.matchers]
        self.ner, self.detect_values, self.safe_domains = ner, detect_values, safe_domains
        self.matches: Counter[int] = Counter()
        self.absorbed: Counter[int] = Counter()
        self.events: list[tuple[str, str]] = []
        self.automatic: Counter[str] = Counter()
        self._suggested: dict[tuple[str, str], Suggestion] = {}
        self._placeholders: dict[str, str] = {}
        self._numbers: Counter[str] = Counter()
        self._protected = frozenset(X.canonical("value", r.target) for r in self.rules if r.target)
        targets = [re.escape(r.target) for r in self.rules if r.target]
        self._targets = [re.compile(t) for t in targets]
        self._seen: tuple[str | None, list[Detection]] = None, []

    @property
    def suggestions(self) -> list[Suggestion]:
        return list(self._suggested.values())

    def placeholder(self, kind: str, value: str) -> str:
        """The value's placeholder; a new one takes the next number of its prefix."""
        key = X.canonical("value", value)
        if key not in self._placeholders:
            prefix = X.prefix_of(kind)
            self._numbers[prefix] += 1
            self._placeholders[key] = X.placeholder(prefix, self._numbers[prefix])
        return self._placeholders[key]

    def is_protected(self, kind: str, value: str) -> bool:
        return X.is_safe(kind, value, self.safe_domains) or X.canonical("value", value) in self._protected

    def suggest(self, d: Detection) -> None:
        target = self.placeholder(d.placeholder_kind, d.value)
        self._suggested.setdefault((d.kind, X.canonical(d.kind, d.value)), suggestion(d, target))

    def _apply_rules(self, text: str) -> list[Edit]:
        choice = choose(rule_edits(text, self.matchers))
        for loser, winner in choice.lost:
            self.absorbed[loser.index] += 1
            self.events.append((f"rule-{loser.index + 1:04d}", f"rule-{winner.index + 1:04d}"))
        self.matches.update(e.index for e in choice.selected)
        return choice.selected

    def _apply_detections(self, found: Iterable[Detection], waits: Callable[[Detection], bool]) -> list[Edit]:
        """Edits for detections; what ``waits`` becomes a suggestion unless an edit covers part of it."""
        edits: list[Edit] = []
        waiting: list[Detection] = []
        for d in found:
            if waits(d) or self.is_protected(d.kind, d.value):
                waiting.append(d)
            else:
                edits.append(Edit(d.start, d.end, self.placeholder(d.placeholder_kind, d.value), d.kind, -1, V.PRIORITY.get(d.kind, V.OTHER_PRIORITY)))
        chosen = choose(edits).selected
        taken = Apart((e.start, e.end) for e in chosen)
        for d in waiting:
            if not taken.met(d.start, d.end):
                self.suggest(d)
        self.automatic.update(e.kind for e in chosen)
        return chosen

    def _detected(self, text: str) -> list[Edit]:
        """Detections outside what rules have put in, which is blanked for the detectors."""
        done = Apart(m.span() for t in self._targets for m in t.finditer(text))
        masked = splice(text, [Edit(a, b, " " * (b - a), "") for a, b in done.spans])
        self._seen = masked, detect(masked, safe_domains=self.safe_domains)
        found = (d for d in self._seen[1] if not done.met(d.start, d.end))
        return self._apply_detections(found, lambda d: not d.automatic)

    def residual(self, text: str) -> list[Suggestion]:
        """What the detectors find in an output text; one that they have just seen is not searched again."""
        if self._seen[0] == text and self.safe_domains == V.SAFE_DOMAINS:
            return merge_suggestions(map(suggestion, self._seen[1]))
        return residual(text)

    def _entities(self, text: str) -> list[Edit]:
        ner = self.ner
        return self._apply_detections(ner.detect(text), lambda d: ner.suggest_only or d.confidence < ner.threshold)

    def apply_with_edits(self, text: str) -> tuple[str, list[Edit]]:
        """The new text, and all edits in places of the original one."""
        stages = [self._apply_rules]
        if self.detect_values:
            stages.append(self._detected)
        if self.ner is not None:
            stages.append(self._entities)
        origin = _Origin()
        edits: list[Edit] = []
        for at, stage in enumerate(stages, 1):
            chosen = stage(text)
            edits += [Edit(*span, e.replacement, "transformed", -1, 1) for e in chosen if (span := origin.of(e))]
            if chosen:
                if at < len(stages):
                    origin.advance(chosen)
                text = splice(text, chosen)
        return text, sorted(edits, key=lambda e: (e.start, e.end))

    def apply(self, text: str, markup: str | None = None) -> str:
        """The new text.  With markup, names that tags interrupt are found in the visible text, then the source is treated too."""
        if markup:
            shown = visible(text, markup)
            if shown.has_markup and shown.text:
                _, edits = self.apply_with_edits(shown.text)
                if edits:
                    text = _into_source(text, shown.positions, edits)
        return self.apply_with_edits(text)[0]

    def fuzzy(self, text: str, index: int) -> str:
        """One rule's fuzzy matches alone."""
        chosen = choose(self.matchers[index].fuzzy(text)).selected
        self.matches[index] += len(chosen)
        return splice(text, chosen)


def _into_source(text: str, positions: Sequence[int | None], edits: Sequence[Edit]) -> str:
    """Edits of the visible text put into the source: at their first character, the others are blanked, markup stays."""
    out = list(text)
    for e in reversed(edits):
        places = [p for p in positions[e.start : e.end] if p is not None]
        for p in places[1:]:
            out[p] = ""
        if places:
            out[places[0]] = e.replacement
    return "".join(out)
