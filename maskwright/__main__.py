"""Command line: python -m maskwright FILE [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions import vocabulary as V
from .plans.pipeline import Options, Refused, run_file, run_images
from .sources.files import Reading
from .sources.models import NerSpec
from .sources.rules import load_rules


INSTALL = """Text, CSV, DOCX and XLSX files need nothing besides Spark.
PDF files: pymupdf.  Pictures and recognition: pillow, pytesseract and the tesseract program.
Entities: spacy and a model on disk.  Nothing is ever downloaded."""


def ask(problem: str) -> bool:
    """Whether the user at a terminal wants the output in spite of a problem; anything but yes is no."""
    print(f"maskwright: {problem}", file=sys.stderr)
    return input("Write the output anyway? [y/N] ").strip().casefold() in ("y", "yes")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("maskwright")
    p.add_argument("input", nargs="?")
    p.add_argument("-o", "--output")
    p.add_argument("--format", choices=("markdown", "text", "images"), default="markdown")
    p.add_argument("--replace", action="append", default=[], metavar="SOURCE=TARGET")
    p.add_argument("--rules", help="a JSON file of rules")
    p.add_argument("--report")
    p.add_argument("--document-label")
    p.add_argument("--fuzzy-threshold", type=float, default=V.FUZZY_THRESHOLD)
    p.add_argument("--ner-model")
    p.add_argument("--ner-language", default="es")
    p.add_argument("--ner-threshold", type=float, default=0.85)
    p.add_argument("--dpi", type=int, default=220)
    p.add_argument("--min-ocr-conf", type=float, default=45)
    p.add_argument("--ocr-lang", default="eng+spa")
    p.add_argument("--image-fill", default="#ffffff")
    p.add_argument("--image-text", default="#111111")
    p.add_argument("--redact-header", type=float, default=0)
    p.add_argument("--header-text", default="REDACTED")
    p.add_argument("--redact-region", action="append", default=[], metavar="X,Y,W,H[=LABEL]")
    for flag in ("enable-ner", "suggest-only-ner", "ocr", "force-ocr", "quiet", "no-pet", "no-interactive", "help-install", "case-sensitive", "exact", "no-fuzzy", "no-preserve-case", "require-all-rules", "strict-pii", "no-suggest-pii", "allow-zero-replacements"):
        p.add_argument(f"--{flag}", action="store_true")
    kinds = p.add_mutually_exclusive_group()
    kinds.add_argument("--safe-report", action="store_true", help="no value of the source in the report; the default")
    kinds.add_argument("--unsafe-report", action="store_true", help="values of the source in the report")
    a = p.parse_args(argv)
    if a.help_install:
        print(INSTALL)
        return 0
    if a.input is None:
        p.error("an input file is needed")
    if a.unsafe_report:
        print("maskwright: the report may hold values of the source", file=sys.stderr)
    try:
        text = open(a.rules, encoding="utf-8").read() if a.rules else None
        rules = load_rules(a.replace, text, case_sensitive=a.case_sensitive, smart=not a.exact, preserve_case=not a.no_preserve_case, fuzzy_threshold=0.0 if a.no_fuzzy else a.fuzzy_threshold)
        options = Options(tuple(rules), a.require_all_rules, a.strict_pii, a.allow_zero_replacements, not a.no_suggest_pii, not a.unsafe_report, a.document_label, NerSpec(a.ner_model, a.ner_language, a.ner_threshold, a.suggest_only_ner) if a.enable_ner or a.ner_model or a.suggest_only_ner else None, Reading(a.ocr, a.force_ocr, a.ocr_lang, a.dpi))
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        confirm = ask if sys.stdin.isatty() and not a.no_interactive else lambda _: False
        if a.format == "images":
            how = dict(dpi=a.dpi, least=a.min_ocr_conf, language=a.ocr_lang, force_ocr=a.force_ocr, fill=a.image_fill, ink=a.image_text, header=a.redact_header, header_text=a.header_text, regions=a.redact_region)
            print(*run_images(spark, a.input, a.output, a.report, options, confirm, **how), sep="\n")
        else:
            tell = (lambda text: None) if a.quiet else (lambda text: print(text, file=sys.stderr))
            print(run_file(spark, a.input, a.output, a.report, options, ".md" if a.format == "markdown" else ".txt", tell, confirm))
    except (ValueError, Refused, OSError) as e:
        print(f"maskwright: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
