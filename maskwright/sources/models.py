"""Named-entity models from local files or installed packages; never from the network."""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import lru_cache

from ..operators.session import Ner


@dataclass
class ModelReport:
    enabled: bool = True
    available: bool = False
    language: str = "es"
    load_seconds: float = 0.0
    model_disk_bytes: int = 0
    error: str | None = None

    def report(self) -> dict[str, object]:
        return asdict(self) | {"fallback": not self.available}


def disk_bytes(path: str) -> int:
    if os.path.isfile(path):
        return os.path.getsize(path)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def load_model(path: str | None = None, language: str = "es"):
    """(model, report): a callable from text to (label, start, end, score or None), or None with the reason told.

    Without a path the installed package ``<language>_core_news_sm`` is used.
    """
    told = ModelReport(language=language)
    if path and path.startswith(("http://", "https://")):
        told.error = "remote model paths are disabled"
        return None, told
    if path and not os.path.exists(os.path.expanduser(path)):
        told.error = "local NER model path does not exist"
        return None, told
    start = time.perf_counter()
    try:
        nlp = importlib.import_module("spacy").load(os.path.expanduser(path) if path else f"{language}_core_news_sm")
    except (ImportError, OSError, RuntimeError, ValueError) as e:
        told.error = type(e).__name__  # the type alone: messages may hold text
        return None, told
    finally:
        told.load_seconds = round(time.perf_counter() - start, 6)
    told.available, told.model_disk_bytes = True, disk_bytes(os.path.expanduser(path)) if path else 0

    def model(text: str) -> Iterable[tuple[str, int, int, float | None]]:
        for e in nlp(text).ents:
            score = getattr(e, "score", None)
            yield e.label_, e.start_char, e.end_char, score if score is not None else getattr(e._, "confidence", None)

    return model, told


@dataclass(frozen=True)
class NerSpec:
    """Which model a job uses; every Python worker loads it once, at its first document."""

    path: str | None = None
    language: str = "es"
    threshold: float = 0.85
    suggest_only: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold of a model is between 0 and 1")

    def open(self) -> Ner | None:
        """The model, or None where it cannot be had: then the detectors work alone."""
        model, _ = _loaded(self.path, self.language)
        return Ner(model, self.threshold, self.suggest_only) if model else None

    def report(self) -> dict[str, object]:
        return _loaded(self.path, self.language)[1].report() | {"threshold": self.threshold, "suggest_only": self.suggest_only}


_loaded = lru_cache(maxsize=4)(load_model)
