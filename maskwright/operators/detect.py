"""Detectors: text to sensitive spans, with offsets in code points.

Every detector yields (kind, start, end, confidence, reason, automatic); the
spans that are placeholders already are left out, repeated (kind, start, end)
keep the highest confidence, and the order is by start, then the longest, then
the kind's priority.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial
from typing import NamedTuple

from ..functions import text as X
from ..functions import vocabulary as V
from .structure import Structure


class Detection(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    confidence: float
    reason: str
    placeholder_kind: str
    automatic: bool = True
    source: str = "deterministic"


Found = tuple[str, int, int, float, str, bool]
_CUT = re.compile(r"https?://|\b[\w.+-]+@[\w.-]+\.", re.I)
_TRIM = " \t\r\n\"'“”«»`()[]{}<>*_~"


class _Hints:
    """What a text holds at all, looked up once; a pattern that needs what is missing is not tried."""

    def __init__(self, text: str):
        self.folded = text.casefold()
        # letters that match i without folding to it
        self.any = "\u0131" in text or "\u0130" in text
        self.text = text
        self.digits = _DIGIT.search(text) is not None

    @cached_property
    def numbers(self) -> list[int]:
        """Where a phone, identifier or date can begin."""
        return [m.start() for m in _NUMBER_START.finditer(self.text)] if self.digits else []

    @cached_property
    def labels(self) -> list[int]:
        """Words before a colon, equals sign or hyphen."""
        return [m.start() for m in _LABEL_START.finditer(self.text)]

    def has(self, stems: tuple[str, ...]) -> bool:
        return self.any or any(stem in self.folded for stem in stems)


def _matches(pattern: re.Pattern[str], text: str, starts: Iterable[int]) -> Iterator[re.Match[str]]:
    """As ``finditer``, given all places in order at which a match, never an empty one, can begin."""
    at = 0
    for start in starts:
        if start >= at and (m := pattern.match(text, start)):
            yield m
            at = m.end()


def mails(text: str) -> Iterator[re.Match[str]]:
    """Mail addresses, looked for from each @ backwards."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and text[start - 1] in _MAIL_LETTERS:
            start -= 1
        m = next(_matches(V.EMAIL, text, range(start, sign)), None)
        if m:
            yield m
        at = m.end() if m else sign + 1


_DIGIT = re.compile(r"\d")
# Sets first and what stands before them second, so that searches can skip; \u0130, \u0131, \u017f and \u212a match i, s and k.
_NUMBER_START = re.compile(r"[(+\d](?<!\w[(+\d])")
_LABEL_START = re.compile(r"\b\w++\s*+[:=-]")
_ACCOUNT_START = re.compile(r"[AaBbCcIi\u0130\u0131NnSs\u017f](?<!\w.)")
_IDENTIFIER_START = re.compile(r"[DdIi\u0130\u0131PpRrTt](?<!\w.)")
_MAIL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-\u0130\u0131\u017f\u212a")
_ACCOUNT_STEMS = ("cuenta", "account", "iban", "swift")
_IDENTIFIER_STEMS = ("id", "ruc", "pasaporte", "passport")
_ADDRESS_STEMS = ("direcci", "domicilio", "address", "residenc")
_LOCATION_STEMS = ("ubicaci", "lugar", "localizaci", "location", "city", "ciudad", "country", "pa")
_VALUE_STEMS = ("valor", "value", "dat")
_COMPANY_STEMS = ("empresa", "compa", "sociedad", "corporaci", "proveedor", "cliente", "organization", "vendor", "supplier", "bank", "banco")


def clean(value: str) -> str:
    """A field's value without what follows a web or mail address, and without delimiters around."""
    m = _CUT.search(value)
    if m and m[0].lower().startswith("http"):
        value = value[: m.start()]
    elif m:
        web = re.search(r"https?://", value, re.I)
        value = value[: min(m.start(), web.start() if web else len(value))]
    return value.strip(_TRIM).rstrip(" \t,;:.")


def _cleaned(text: str, start: int, end: int) -> tuple[int, int]:
    raw = text[start:end]
    value = clean(raw)
    at = raw.find(value) if value else 0
    return start + at, start + at + len(value)


def label_before(text: str, at: int, labels: frozenset[str]) -> bool:
    """Whether one of ``labels`` is among the words just before ``at``."""
    return not labels.isdisjoint(V.LABEL_WORD.findall(text[max(0, at - V.LOOK_BACK) : at].casefold()))


def _is_placeholder_head(text: str, m: re.Match[str]) -> bool:
    return bool(V.PLACEHOLDER_LABEL.fullmatch(text[m.start() : m.start("value")].strip()))


def _compact(value: str) -> int:
    return len(re.sub(r"[\s-]", "", value))


def _accounts(text: str) -> list[tuple[int, int]]:
    return [m.span("value") for m in _matches(V.ACCOUNT, text, (s.start() for s in _ACCOUNT_START.finditer(text))) if _compact(m["value"]) >= 8 and not _is_placeholder_head(text, m)]


def _numbers(text: str, structure: Structure, hints: _Hints) -> Iterator[Found]:
    reason = "deterministic pattern"
    for m in mails(text):
        yield "email", *m.span(), 0.99, reason, True
    for m in _matches(V.PHONE, text, hints.numbers):
        if not label_before(text, m.start(), V.IDENTIFIER_LABELS):
            yield "phone", *m.span(), 0.99, reason, True
    accounts = _accounts(text) if hints.has(_ACCOUNT_STEMS) else []
    for m in _matches(V.IDENTIFIER, text, hints.numbers):
        start, end = m.span()
        at = bisect_right(accounts, (start, len(text)))  # accounts are apart and in order
        if at and accounts[at - 1][0] <= start and end <= accounts[at - 1][1]:
            continue
        value = m[0].strip()
        if not (V.DATE.fullmatch(value) or V.PHONE.fullmatch(value) or V.CURRENCY_BEFORE.search(text[max(0, start - 6) : start])):
            yield "id_or_ruc", start, end, 0.99, reason, True
    for m in _matches(V.IDENTIFIER_FIELD, text, (s.start() for s in _IDENTIFIER_START.finditer(text))) if hints.has(_IDENTIFIER_STEMS) else ():
        if not _is_placeholder_head(text, m):
            yield "id_or_ruc", *_cleaned(text, *m.span("value")), 0.99, "identifier label", True
    for span in accounts:
        yield "account", *span, 0.96, "account label", True
    for m in _matches(V.DATE, text, hints.numbers):
        told = V.DATE_WORDS.search(text[max(0, m.start() - V.LOOK_BACK) : m.start()].casefold())
        yield "date", *m.span(), 0.93 if told else 0.90, "identity-associated date" if told else "date pattern", True


def _streets(text: str, structure: Structure, hints: _Hints) -> Iterator[Found]:
    for m in V.STREET.finditer(text):
        start, end = _cleaned(text, *m.span())
        if len(X.words(text[start:end])) >= 2:
            yield "address", start, end, 0.91, "address pattern", True


def _field(kind: str, pattern: re.Pattern[str], stems: tuple[str, ...], least: int, most: int, confidence: float, reason: str, text: str, structure: Structure, hints: _Hints) -> Iterator[Found]:
    for m in _matches(pattern, text, hints.labels) if hints.has(stems) else ():
        if _is_placeholder_head(text, m):
            continue
        start, end = _cleaned(text, *m.span("value"))
        if kind == "organization" and m["label"].casefold() == "cliente" and not V.CORPORATE.search(text[start:end]):
            continue
        if least <= len(X.words(text[start:end])) <= most:
            yield kind, start, end, confidence, reason, True


def _in_both_cases(pattern: str) -> str:
    """``pattern`` with a class for each letter: as ignoring case, but a search can skip to the first letters."""
    more = {"s": "\u017f", "i": "\u0130\u0131", "k": "\u212a"}
    return re.sub(r"\\.|\[[^\]]*\]|[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}{more.get(m[0].lower(), '')}]" if m[0].isalpha() else m[0], pattern)


_SUFFIX = re.compile(_in_both_cases(V.SUFFIX_TEXT))


def company_spans(text: str) -> Iterator[tuple[int, int]]:
    """Up to six words and a company suffix, leftmost start first, as far as six words reach.

    Suffixes are found first, also inside longer words.  From each the words
    before it are walked to the left: at most six runs of word characters with
    blanks or commas between.  Every place where a word may start is a start.
    """
    reach: dict[int, int] = {}
    at = 0
    while s := _SUFFIX.search(text, at):
        for start in _company_starts(text, s.start()):
            reach[start] = s.end()
        at = s.start() + 1
    done = 0
    for start in sorted(reach):
        if start >= done:
            done = reach[start]
            yield start, done


def _company_starts(text: str, at: int) -> Iterator[int]:
    for _ in range(V.COMPANY_WORDS):
        while at and text[at - 1] in " \t,":
            at -= 1
        end = at
        while at and V.COMPANY_PART.match(text[at - 1]):
            at -= 1
        for start in range(at, end):
            if V.COMPANY_START.match(text[start]) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                yield start
        if at == end or not V.COMPANY_START.match(text[at]):
            return  # nothing can join words across what stands here


def _companies(text: str, structure: Structure, hints: _Hints) -> Iterator[Found]:
    for a, b in company_spans(text):
        inside, told = structure.in_tag(a, b)
        raw = text[a:b]
        value = clean(raw)
        for marker in V.COMPANY_MARKERS:
            if m := re.search(rf"\b{re.escape(marker)}\b", value, re.I):
                value = value[m.start() :]
                break
        if (not inside or told) and value.casefold() not in V.NOT_NAMES:
            start = a + max(0, raw.find(value))
            yield "organization", start, start + len(value), 0.94, "organization suffix", True


class _Token(NamedTuple):
    words: list[str]
    title: bool
    upper: bool
    words_folded: frozenset[str]


@lru_cache(8192)
def _token(token: str) -> _Token:
    """What a name token of at most 31 characters is, whatever the text around."""
    found = X.words(token)
    return _Token(found, all(len(w) == 1 or (w[0].isupper() and w[1:].islower()) for w in found), all(w == w.upper() for w in found), frozenset(w.casefold() for w in found))


def _names(text: str, structure: Structure, hints: _Hints) -> Iterator[Found]:
    """Phrases of two to four name tokens that look like a person's name."""
    labelled = hints.has(_NAME_LABELS)
    if not labelled and not _CAPITAL_PAIR.search(text):
        return
    raw = list(V.NAME_TOKEN.finditer(text))
    # where no label stands anywhere, a phrase starts and ends with a capital
    first = range(len(raw) - 1) if labelled else [i for i, m in enumerate(raw[:-1]) if not _small(text, m.start())]
    for i in first:
        start = raw[i].start()
        for j in range(i + 1, min(i + 4, len(raw))):
            if not V.NAME_JOINT.fullmatch(text, raw[j - 1].end(), raw[j].start()):
                break
            if not labelled and _small(text, raw[j].start()):
                continue
            parts = [_token(raw[k][0]) for k in range(i, j + 1)]
            end = raw[j].end()
            if verdict := _plausible(text, start, end, parts, structure):
                confidence, automatic = verdict
                inside, told = structure.in_tag(start, end)
                if not inside or told:
                    reason = "structured name-like phrase" if structure.inside(start, end) else "name-like phrase"
                    yield "person" if automatic else "possible_person", start, start + len(text[start:end].strip(V.EDGE)), confidence, reason, automatic


_NAME_LABELS = tuple(sorted(V.NAME_LABELS))
# Two name tokens in a row, each with a capital first or a single letter and an apostrophe or hyphen.
_LETTERS, _FIRST = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’\\-", "(?:[A-ZÁÉÍÓÚÜÑ]|[a-záéíóúüñ](?=['’\\-]))"
_CAPITAL_PAIR = re.compile(rf"{_FIRST}[{_LETTERS}]{{1,30}}(?:{V.NAME_JOINT.pattern}){_FIRST}[{_LETTERS}]")


def _small(text: str, at: int) -> bool:
    """Whether a word of several characters starts in lower case here."""
    return text[at].islower() and text[at + 1].isalnum()


def _plausible(text: str, start: int, end: int, parts: list[_Token], structure: Structure) -> tuple[float, bool] | None:
    n = sum(len(p.words) for p in parts)
    folded = frozenset().union(*(p.words_folded for p in parts))
    if not 2 <= n <= 4 or folded <= V.GENERIC_WORDS or folded <= V.NAME_LABELS or folded & V.NOT_PERSON_WORDS:
        return None
    if text[start:end].strip(V.EDGE).casefold() in V.NOT_NAMES:
        return None
    cased = all(p.title for p in parts) or all(p.upper for p in parts)
    labelled = label_before(text, start, V.NAME_LABELS)
    named = bool(folded & V.NAME_LABELS)
    if not (cased or labelled or named):
        return None
    bounded = structure.inside(start, end)
    if folded & V.GENERIC_WORDS and not (bounded or labelled or named):
        return None
    return (0.96 if bounded or labelled else 0.91 if cased else 0.88), labelled or cased


#: In the order in which equal spans are preferred.
DETECTORS = (
    _numbers,
    _streets,
    partial(_field, "address", V.ADDRESS_FIELD, _ADDRESS_STEMS, 2, 12, 0.97, "address label"),
    partial(_field, "location", V.LOCATION_FIELD, _LOCATION_STEMS, 1, 8, 0.94, "location label"),
    partial(_field, "value", V.VALUE_FIELD, _VALUE_STEMS, 1, 10, 0.88, "value label"),
    partial(_field, "organization", V.COMPANY_FIELD, _COMPANY_STEMS, 1, 10, 0.95, "organization label"),
    _companies,
    _names,
)


def detect(text: str | None, include_low_confidence: bool = True, safe_domains: tuple[str, ...] = V.SAFE_DOMAINS) -> list[Detection]:
    """All sensitive spans of a text."""
    if not text:
        return []
    structure, hints = Structure(text), _Hints(text)
    best: dict[tuple[str, int, int], Detection] = {}
    for detector in DETECTORS:
        for kind, start, end, confidence, reason, automatic in detector(text, structure, hints):
            value = text[start:end].strip()
            if not value or X.is_safe(kind, value, safe_domains) or not (automatic or include_low_confidence):
                continue
            key = kind, start, end
            if key not in best or confidence > best[key].confidence:
                best[key] = Detection(kind, value, start, end, confidence, reason, X.prefix_of(kind), automatic)
    return sorted(best.values(), key=lambda d: (d.start, d.start - d.end, -V.PRIORITY.get(d.kind, 0)))


__all__ = ["DETECTORS", "Detection", "clean", "company_spans", "detect", "label_before"]
