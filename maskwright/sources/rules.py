"""Rules from ``source=target`` lines and from JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from ..operators.matching import Rule


def parse_rule(raw: str, **options) -> Rule:
    source, found, target = raw.partition("=")
    if not found:
        raise ValueError("a rule is written source=target")
    if not source.strip():
        raise ValueError("a rule's source cannot be empty")
    return Rule(source.strip(), target.strip(), **options)


def parse_json(text: str, **options) -> list[Rule]:
    """An object of sources and targets, or a list of objects whose own options come first."""
    data = json.loads(text)
    items = [{"source": s, "target": t} for s, t in data.items()] if isinstance(data, dict) else data
    out = []
    for item in items:
        source, target = item.get("source", item.get("from")), item.get("target", item.get("to"))
        if not source or target is None:
            raise ValueError("every JSON rule needs source (or from) and target (or to)")
        own = {k: kind(item[k]) for k, kind in (("case_sensitive", bool), ("smart", bool), ("preserve_case", bool), ("fuzzy_threshold", float)) if k in item}
        out.append(Rule(str(source), str(target), **(options | own)))
    return out


def load_rules(replace: Sequence[str] = (), text: str | None = None, **options) -> list[Rule]:
    """Lines first, then the JSON text."""
    return [*(parse_rule(r, **options) for r in replace), *(parse_json(text, **options) if text else ())]
