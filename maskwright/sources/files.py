"""Files of all kinds as documents: bytes in, anonymized Markdown and a report out."""

from __future__ import annotations

import csv
import importlib.util
import io
import posixpath
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators.columns import RESULT, _summary
from ..operators.matching import Rule
from ..operators.session import Session
from .models import NerSpec
from .office import Docx, Xlsx
from .tables import table

#: Optional libraries by the kind of file that needs them.
NEEDS = {**dict.fromkeys(V.PDF_SUFFIXES, "fitz"), **dict.fromkeys(V.IMAGE_SUFFIXES, "pytesseract")}


class Unsupported(ValueError):
    """A file of unknown kind, or one that needs a library that is missing."""


def suffix_of(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def require(suffix: str) -> None:
    known = V.TEXT_SUFFIXES | V.CSV_SUFFIXES | V.DOCX_SUFFIXES | V.XLSX_SUFFIXES | set(NEEDS)
    if suffix not in known:
        raise Unsupported(f"unsupported file type '{suffix}'")
    if suffix in NEEDS and importlib.util.find_spec(NEEDS[suffix]) is None:
        raise Unsupported(f"missing dependency '{NEEDS[suffix]}' for {suffix} files")


@dataclass(frozen=True)
class Reading:
    """How pages of PDF files and pictures are read: recognition as a fallback, or for every page."""

    ocr: bool = False
    force_ocr: bool = False
    language: str = "eng+spa"
    dpi: int = 220


# What a page without text says, and what stands above recognised text.
NO_TEXT = "[No text layer found. Re-run with --ocr after installing Tesseract.]"
RECOGNISED = "<!-- OCR page: review accuracy before sharing. -->"


def page_text(page) -> str:
    """The text layer, a line for each line that has spans; pages without such a structure give their plain text."""
    try:
        blocks = [b for b in page.get_text("dict")["blocks"] if b.get("type") == 0]
        lines = ("".join(str(s.get("text") or "") for s in line.get("spans", ())) for b in blocks for line in b.get("lines", ()))
        text = "\n".join(filter(None, lines))
    except (AttributeError, KeyError, TypeError, ValueError):
        text = ""
    return text or str(page.get_text("text") or "")


def picture(page, dpi: int):
    """A page drawn as a picture."""
    from PIL import Image

    return Image.open(io.BytesIO(page.get_pixmap(dpi=dpi).tobytes("png")))


def pages_markdown(pages: Iterable, session: Session, label: str, how: Reading, recognise: Callable) -> str:
    """Pages one after the other; ``recognise`` turns a page into text where there is no layer, or for all pages."""
    parts = [f"# {label}"]
    for n, page in enumerate(pages, 1):
        layer = "" if how.force_ocr else page_text(page).strip()
        parts.append(f"## Page {n}")
        if layer or not (how.ocr or how.force_ocr):
            parts.append(session.apply(layer or NO_TEXT))
        else:
            parts += [RECOGNISED, session.apply(recognise(page).strip())]
    return "\n\n".join(parts).strip() + "\n"


def pdf_markdown(content: bytes, session: Session, label: str, how: Reading) -> str:
    import fitz

    def recognise(page) -> str:
        import pytesseract

        return pytesseract.image_to_string(picture(page, how.dpi), lang=how.language)

    with fitz.open(stream=content, filetype="pdf") as book:
        return pages_markdown(book, session, label, how, recognise)


def image_markdown(content: bytes, session: Session, label: str, language: str) -> str:
    import pytesseract
    from PIL import Image

    return f"# {label}\n\n{session.apply(pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang=language).strip())}\n"


def render(content: bytes, suffix: str, session: Session, label: str = V.DOCUMENT_LABEL, how: Reading = Reading()) -> str:
    """A file's anonymized Markdown."""
    require(suffix)
    if suffix in V.CSV_SUFFIXES:
        text = content.decode("utf-8-sig", "replace")
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter="\t" if suffix == ".tsv" else ","))
        return f"# {label}\n\n{table(rows, session)}\n"
    if suffix in V.DOCX_SUFFIXES:
        return Docx(content).markdown(session, label)
    if suffix in V.XLSX_SUFFIXES:
        return Xlsx(content).markdown(session, label)
    if suffix in V.PDF_SUFFIXES:
        return pdf_markdown(content, session, label, how)
    if suffix in V.IMAGE_SUFFIXES:
        return image_markdown(content, session, label, how.language)
    markup = {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}.get(suffix)
    return session.apply(io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace").read(), markup)


def read_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, content) of files in any store that Spark reads."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path if isinstance(path, str) else list(path)).select("path", "content")


def anonymize_files(files: DataFrame, rules: Sequence[Rule] = (), label: str | None = None, rescan: bool = True, ner: NerSpec | None = None, how: Reading = Reading()) -> DataFrame:
    """``files`` (path, content) as path, label, text, counts, suggestions and error.

    A file that cannot be read has an error and no text; it never passes a gate.
    Without a label, documents are labelled by a digest of their path.
    """
    fields = RESULT.replace("text string, ", "", 1)

    def run(batches):
        for batch in batches:
            out = []
            for path, content, name in zip(batch["path"], batch["content"], batch["label"], strict=True):
                session, text, error = Session(rules, ner.open() if ner else None), None, None
                try:
                    text = render(content, suffix_of(path), session, name, how)
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job; the type says no content
                    error = str(e) if isinstance(e, Unsupported) else type(e).__name__
                out.append({"path": path, "label": name, "error": error, **_summary(session, text, [], rescan and text is not None)})
            yield pd.DataFrame(out)

    name = F.lit(X.document_label(label)) if label else F.concat(F.lit("DOCUMENT-"), F.substring(F.sha2("path", 256), 1, 12))
    return files.withColumn("label", name).select("path", "label", "content").mapInPandas(run, f"path string, label string, error string, text string, {fields}")
