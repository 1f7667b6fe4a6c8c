"""Redaction of positioned words: which boxes are covered, with what text, and the drawing where Pillow is present."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .detect import Detection, detect
from .matching import Rule, WordBox, box_groups
from .session import Session

REDACTION = "struct<left:int,top:int,right:int,bottom:int,text:string,kind:string>"
WORDS = "array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>"


class Redaction(NamedTuple):
    left: int
    top: int
    right: int
    bottom: int
    text: str
    kind: str


def parse_color(value: str) -> tuple[int, int, int]:
    """#rrggbb as red, green and blue."""
    digits = value.strip().removeprefix("#")
    if len(digits) != 6 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError("a colour is six hexadecimal digits")
    return tuple(bytes.fromhex(digits))


def parse_region(value: str) -> Redaction:
    """x,y,width,height with an optional =label."""
    numbers, _, label = value.partition("=")
    try:
        x, y, width, height = (int(float(n)) for n in numbers.split(","))
    except ValueError:
        raise ValueError("a region is x,y,width,height or x,y,width,height=label") from None
    if width <= 0 or height <= 0:
        raise ValueError("a region's width and height are positive")
    return Redaction(x, y, x + width, y + height, label.strip() or "REDACTED", "region")


def around(boxes: Sequence[WordBox], width: int, height: int) -> tuple[int, int, int, int]:
    """The box around all, three wider and two higher on each side, inside the page."""
    return (
        int(max(0, min(b.left for b in boxes) - 3)), int(max(0, min(b.top for b in boxes) - 2)),
        int(min(width, max(b.right for b in boxes) + 3)), int(min(height, max(b.bottom for b in boxes) + 2)),
    )


def word_redactions(boxes: Sequence[WordBox], session: Session, width: int, height: int) -> list[Redaction]:
    """Rules in their order first, then detections in the joined words: the longest, then by kind; no word twice."""
    used: set[int] = set()
    out: list[Redaction] = []

    def cover(group: Iterable[int], text: str, kind: str) -> None:
        group = list(group)
        used.update(group)
        out.append(Redaction(*around([boxes[i] for i in group], width, height), text, kind))

    for index, rule in enumerate(session.rules):
        for group in box_groups(boxes, rule):
            if used.isdisjoint(group):
                session.matches[index] += 1
                cover(group, rule.replacement(" ".join(boxes[i].text for i in group)), "rule")
    ranges, at = [], 0
    for b in boxes:
        ranges.append((at, at + len(b.text)))
        at += len(b.text) + 1
    joined = " ".join(b.text for b in boxes)
    found = [d for d in detect(joined, safe_domains=session.safe_domains) if d.automatic]
    if session.ner is not None and joined:
        found += session.ner.detect(joined)
    taken: list[Detection] = []
    for d in sorted(found, key=lambda d: (d.start - d.end, -V.PRIORITY.get(d.kind, 0), d.start)):
        if session.is_protected(d.kind, d.value):
            continue
        if d.source == "spacy" and (session.ner.suggest_only or d.confidence < session.ner.threshold):
            session.suggest(d)
            continue
        group = [i for i, (a, b) in enumerate(ranges) if b > d.start and a < d.end]
        if group and used.isdisjoint(group) and all(d.end <= t.start or t.end <= d.start for t in taken):
            taken.append(d)
            session.automatic[d.kind] += 1
            cover(group, session.placeholder(d.placeholder_kind, d.value), d.kind)
    return out


def page_redactions(width: int, height: int, header: float = 0, header_text: str = "REDACTED", regions: Sequence[str] = ()) -> list[Redaction]:
    """A header, as a share of the height up to 1 or in pixels, and regions cut to the page."""
    out = []
    if header:
        high = max(1, min(height, int(height * header) if header <= 1 else int(header)))
        out.append(Redaction(0, 0, width, high, header_text, "header"))
    for r in map(parse_region, regions):
        cut = lambda v, most: max(0, min(most, v))
        out.append(Redaction(cut(r.left, width), cut(r.top, height), cut(r.right, width), cut(r.bottom, height), r.text, r.kind))
    return out


def redactions(rules: Sequence[Rule] = (), header: float = 0, header_text: str = "REDACTED", regions: Sequence[str] = ()):
    """Column function: (words, width, height) of a page to its redactions."""

    @F.pandas_udf(f"array<{REDACTION}>")
    def run(words: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for boxes, w, h in zip(words, width, height, strict=True):
            boxes = [WordBox(**{f: b[f] for f in WordBox._fields}) for b in (boxes if boxes is not None else [])]
            found = word_redactions(boxes, Session(rules), int(w), int(h)) + page_redactions(int(w), int(h), header, header_text, regions)
            out.append([r._asdict() for r in found])
        return pd.Series(out)

    return run


# Fonts in the order in which they are tried, margins, and sizes of text in a covered box.
FONTS = ("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf", "/System/Library/Fonts/Supplemental/Arial.ttf", "/Library/Fonts/Arial.ttf")
MARGIN, FIRST_SHARE, FIRST_LEAST, LEAST_SIZE = (3, 2), 0.85, 8, 6


def load_font(size: int):
    """The first font that is there, else Pillow's own."""
    from PIL import ImageFont

    found = next((f for f in FONTS if os.path.exists(f)), None)
    return ImageFont.truetype(found, size=size) if found else ImageFont.load_default(size)


def fitting(size: tuple[int, int], measure: Callable[[int], tuple[float, float]]) -> int:
    """The font size for a box of ``size``: from most of its height down until the text, as ``measure`` tells, is inside the margins."""
    width, height = (max(1, side - 2 * margin) for side, margin in zip(size, MARGIN, strict=True))
    first = max(FIRST_LEAST, int(height * FIRST_SHARE))
    return next((n for n in range(first, LEAST_SIZE, -1) if all(a <= b for a, b in zip(measure(n), (width, height), strict=True))), LEAST_SIZE)


def draw(image, covers: Iterable[Redaction], fill: str = "#ffffff", ink: str = "#111111"):
    """A Pillow image with the redactions drawn, their texts as large as fits."""
    from PIL import ImageDraw

    image = image.convert("RGB")
    canvas = ImageDraw.Draw(image)
    for r in covers:
        canvas.rectangle((r.left, r.top, r.right, r.bottom), fill=parse_color(fill))

        def measure(size: int, text: str = r.text) -> tuple[float, float]:
            left, top, right, bottom = canvas.textbbox((0, 0), text, font=load_font(size))
            return right - left, bottom - top

        size = fitting((r.right - r.left, r.bottom - r.top), measure)
        canvas.text((r.left + MARGIN[0], r.top + MARGIN[1]), r.text, fill=parse_color(ink), font=load_font(size))
    return image
