"""Word-processing and spreadsheet files, read with the standard library."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree as ET

from ..operators.session import Session
from .tables import rendered_table, table, trim_edges

_OFF = frozenset(("0", "false", "off", "none"))


def local(element: ET.Element) -> str:
    return str(element.tag).rpartition("}")[2]


def attribute(element: ET.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), "")


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels".lstrip("/")
    if path not in archive.namelist():
        return {}
    return {e.get("Id", ""): e.get("Target", "") for e in ET.fromstring(archive.read(path))}


def _beside(part: str, target: str) -> str:
    if target.startswith("/"):
        return target.lstrip("/")
    steps = part.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            steps.pop()
        elif step != ".":
            steps.append(step)
    return "/".join(steps)


class Segment(NamedTuple):
    """A stretch of a paragraph with one style."""

    text: str
    start: int
    end: int
    bold: bool = False
    italic: bool = False
    underline: bool = False
    highlight: bool = False
    url: str | None = None

    def wrapped(self, text: str) -> str:
        if not text:
            return ""
        for on, head, tail in ((self.underline, "<u>", "</u>"), (self.highlight, "<mark>", "</mark>"), (self.italic, "_", "_"), (self.bold, "**", "**"), (self.url, "[", f"]({self.url})")):
            if on:
                text = f"{head}{text}{tail}"
        return text


def _style(run: ET.Element) -> dict[str, bool]:
    names = {"b": "bold", "i": "italic", "u": "underline", "highlight": "highlight"}
    sheet = next((c for c in run if local(c) == "rPr"), None)
    return {} if sheet is None else {names[local(p)]: attribute(p, "val").casefold() not in _OFF for p in sheet if local(p) in names}


def segments(paragraph: ET.Element, targets: dict[str, str]) -> list[Segment]:
    """Texts, tabs and breaks in order; deleted and moved-away text is left out."""
    out: list[Segment] = []

    def walk(e: ET.Element, style: dict, url: str | None) -> None:
        for child in e:
            name = local(child)
            if name in ("del", "moveFrom"):
                continue
            text = child.text or "" if name == "t" else {"tab": "\t", "br": "\n", "cr": "\n"}.get(name, "")
            if text:
                at = out[-1].end if out else 0
                out.append(Segment(text, at, at + len(text), **style, url=url))
            walk(child, _style(child) if name == "r" else style, (targets.get(attribute(child, "id")) or None) if name == "hyperlink" else url)

    walk(paragraph, {}, None)
    return out


def paragraph_markdown(parts: list[Segment], session: Session) -> str:
    """Anonymized text with its styles; a replacement stands where its first character stood."""
    whole = "".join(s.text for s in parts)
    _, edits = session.apply_with_edits(whole)
    out = []
    for s in parts:
        text, at = [], s.start
        for e in edits:
            if e.end <= s.start or e.start >= s.end:
                continue
            text.append(whole[at : max(e.start, at)])
            if e.start >= s.start:
                text.append(e.replacement)
            at = min(max(at, e.end), s.end)
        text.append(whole[at : s.end])
        out.append(s.wrapped("".join(text)))
    done = "".join(out)
    if edits and not any(e.replacement in done for e in edits):
        return session.apply(whole)  # never leave a value whose place was lost
    return done


class Docx:
    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.main = "word/document.xml"
        self.targets = _targets(self.archive, self.main)
        self.root = ET.fromstring(self.archive.read(self.main))

    def blocks(self, parent: ET.Element, targets: dict[str, str], session: Session) -> Iterator[str]:
        for child in parent:
            if local(child) == "p":
                text = paragraph_markdown(segments(child, targets), session).strip()
            elif local(child) == "tbl":
                text = rendered_table([[self._cell(c, targets, session) for c in row if local(c) == "tc"] for row in child if local(row) == "tr"], session)
            else:
                continue
            if text:
                yield text

    def _cell(self, cell: ET.Element, targets: dict[str, str], session: Session) -> str:
        lines = (paragraph_markdown(segments(p, targets), session).strip() for p in cell if local(p) == "p")
        return "<br>".join(line for line in lines if line)

    def markdown(self, session: Session, label: str) -> str:
        body = next((e for e in self.root if local(e) == "body"), self.root)
        parts = [f"# {label}", *self.blocks(body, self.targets, session)]
        seen = set()
        for e in self.root.iter():
            role = {"headerReference": "Header", "footerReference": "Footer"}.get(local(e))
            target = self.targets.get(attribute(e, "id")) if role else None
            path = _beside(self.main, target) if target else ""
            if path and path not in seen and path in self.archive.namelist() and attribute(e, "type") in ("", "default"):
                seen.add(path)
                texts = list(self.blocks(ET.fromstring(self.archive.read(path)), _targets(self.archive, path), session))
                if texts:
                    parts += [f"## {role}", "\n\n".join(texts)]
        told: dict[str, None] = {}
        for e in body.iter():
            if local(e) in ("docPr", "cNvPr"):
                for name in ("descr", "title"):
                    if value := attribute(e, name).strip():
                        told[value] = None
        if told:
            parts += ["## Text alternatives", "\n".join(f"- {session.apply(v)}" for v in told)]
        for name, head in (("comments", "Comments"), ("footnotes", "Footnotes"), ("endnotes", "Endnotes")):
            try:
                root = ET.fromstring(self.archive.read(f"word/{name}.xml"))
            except (KeyError, ET.ParseError):
                continue
            text = session.apply(" ".join(e.text for e in root.iter() if local(e) == "t" and e.text).strip())
            if text.strip():
                parts += [f"## {head}", text]
        return "\n\n".join(parts).strip() + "\n"


# Number formats that stand for dates and times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


class Xlsx:
    """Sheets in order, values only; formulas count by their stored result."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        names = self.archive.namelist()
        self.book = ET.fromstring(self.archive.read("xl/workbook.xml"))
        self.targets = _targets(self.archive, "xl/workbook.xml")
        self.shared = ["".join(t.text or "" for t in e.iter() if local(t) == "t") for e in ET.fromstring(self.archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()
        self.epoch = datetime.datetime(1904, 1, 1) if any(attribute(e, "date1904") in ("1", "true") for e in self.book.iter()) else datetime.datetime(1899, 12, 30)

    def _date_styles(self) -> set[int]:
        root = ET.fromstring(self.archive.read("xl/styles.xml"))
        own = {int(e.get("numFmtId", 0)) for e in root.iter() if local(e) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))}
        formats = next((e for e in root if local(e) == "cellXfs"), [])
        return {i for i, e in enumerate(formats) if int(e.get("numFmtId", 0)) in _DATE_FORMATS | own}

    def _value(self, cell: ET.Element) -> object:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if local(t) == "t")
        raw = next((e.text for e in cell if local(e) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return raw == "1"
        if kind != "n":
            return raw
        number = float(raw)
        if int(cell.get("s", 0)) in self.dates:
            return self.epoch + datetime.timedelta(seconds=round(number * 86400))
        return number if re.search(r"[.eE]", raw) else int(raw)

    def sheets(self) -> Iterator[tuple[str, list[list[object]]]]:
        for e in self.book.iter():
            if local(e) != "sheet":
                continue
            rows: list[list[object]] = []
            for row in ET.fromstring(self.archive.read(_beside("xl/workbook.xml", self.targets[attribute(e, "id")]))).iter():
                if local(row) == "row":
                    number = int(row.get("r", len(rows) + 1))
                    rows += [[] for _ in range(number - len(rows))]
                    for cell in (c for c in row if local(c) == "c"):
                        letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                        column = 0
                        for c in letters:
                            column = 26 * column + ord(c) - 64
                        column = column or len(rows[-1]) + 1
                        rows[-1] += [None] * (column - len(rows[-1]))
                        rows[-1][column - 1] = self._value(cell)
            yield e.get("name", ""), rows

    def markdown(self, session: Session, label: str) -> str:
        parts = [f"# {label}"]
        for name, rows in self.sheets():
            parts += [f"## {session.apply(name)}", table(trim_edges(rows), session) or "_Empty sheet._"]
        return "\n\n".join(parts).strip() + "\n"
