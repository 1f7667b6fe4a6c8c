"""Pages of PDF files and images as pictures with positioned words, and redacted pictures; the libraries are optional."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators.boxes import draw, page_redactions, word_redactions
from ..operators.columns import RESULT, _summary
from ..operators.columns import RESULT, _summary
from ..operators.matching import Rule, WordBox
from ..operators.session import Session
from .files import picture, require, suffix_of
from .models import NerSpec


def recognised(data: dict[str, list], least: float) -> list[WordBox]:
    """Words of a recognition result; blanks and known confidences below ``least`` are left out."""
    out = []
    for i, text in enumerate(data.get("text", [])):
        try:
            confidence = float(data["conf"][i])
        except (KeyError, ValueError):
            confidence = -1.0
        if str(text).strip() and not 0 <= confidence < least:
            left, top, width, height = (float(data[k][i]) for k in ("left", "top", "width", "height"))
            out.append(WordBox(str(text).strip(), left, top, left + width, top + height, confidence))
    return out


def text_layer(words: Sequence[tuple], dpi: int) -> list[WordBox]:
    """Words of a PDF page (x0, y0, x1, y1, text, block, line, word) in reading order, in pixels."""
    scale = dpi / 72
    ordered = sorted(words, key=lambda w: (w[5], w[6], w[7], w[1], w[0]))
    return [WordBox(w[4], *(c * scale for c in w[:4])) for w in ordered if w[4].strip()]


def pages(content: bytes, suffix: str, dpi: int, language: str, least: float, force_ocr: bool) -> Iterator[tuple[object, list[WordBox]]]:
    """(picture, words) of every page."""
    require(suffix)
    from PIL import Image

    def ocr(image) -> list[WordBox]:
        import pytesseract

        return recognised(pytesseract.image_to_data(image, lang=language, output_type=pytesseract.Output.DICT), least)

    if suffix in V.IMAGE_SUFFIXES:
        image = Image.open(io.BytesIO(content))
        yield image, ocr(image)
        return
    import fitz

    with fitz.open(stream=content, filetype="pdf") as book:
        for page in book:
            image = picture(page, dpi)
            yield image, (not force_ocr and text_layer(page.get_text("words"), dpi)) or ocr(image)


def _counts(session: Session) -> dict:
    told = _summary(session, None, [], False)
    del told["text"]
    return told


def redact_files(files: DataFrame, rules: Sequence[Rule] = (), label: str | None = None, dpi: int = 220, least: float = 45, language: str = "eng+spa", force_ocr: bool = False, fill: str = "#ffffff", ink: str = "#111111", header: float = 0, header_text: str = "REDACTED", regions: Sequence[str] = (), ner: NerSpec | None = None) -> DataFrame:
    """``files`` (path, content) as a row per page: path, page, name, png, n_redactions, error, and a last row without a picture with the file's counts and suggestions.

    A task holds one drawn page at a time.
    """
    stem, label = X.label_file(label), X.document_label(label)
    counts = RESULT.replace("text string, ", "", 1)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                suffix, session, error = suffix_of(path), Session(rules, ner.open() if ner else None), None
                nothing = _counts(Session(rules))
                n = total = 0
                try:
                    for n, (image, boxes) in enumerate(pages(content, suffix, dpi, language, least, force_ocr), 1):
                        found = word_redactions(boxes, session, *image.size) + page_redactions(*image.size, header, header_text, regions)
                        png = io.BytesIO()
                        draw(image, found, fill, ink).save(png, "PNG")
                        name = f"{stem}-page-{n:04d}.png" if suffix in V.PDF_SUFFIXES else f"{stem}-image.png"
                        total += len(found)
                        yield pd.DataFrame([{"path": path, "label": label, "page": n, "name": name, "png": png.getvalue(), "n_redactions": len(found), "error": None, **nothing}])
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    error = str(e) if isinstance(e, ValueError) else type(e).__name__
                yield pd.DataFrame([{"path": path, "label": label, "page": n + 1, "name": None, "png": None, "n_redactions": total, "error": error, **_counts(session)}])

    kind = f"path string, label string, page int, name string, png binary, n_redactions int, error string, {counts}"
    return files.select("path", "content").mapInPandas(run, kind)
