"""Rows of cells as anonymized Markdown tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators.session import Session


def trim_edges(rows: Sequence[Sequence[object]]) -> list[list[object]]:
    """Without the empty rows and columns at the end."""
    full = [(i, j) for i, row in enumerate(rows) for j, cell in enumerate(row) if cell not in (None, "")]
    if not full:
        return []
    height, width = max(i for i, _ in full) + 1, max(j for _, j in full) + 1
    return [list(row[:width]) for row in rows[:height]]


def contexts(rows: Sequence[Sequence[object]]) -> list[list[str | None]]:
    """For each cell the kind that its left neighbour, or else its column's header, announces."""
    kinds = [[X.cell_kind(cell) for cell in row] for row in rows]
    out: list[list[str | None]] = []
    for i, row in enumerate(kinds):
        line: list[str | None] = []
        for j, own in enumerate(row):
            left = row[j - 1] if j else None
            head = kinds[0][j] if i and j < len(kinds[0]) else None
            line.append(None if own else left or head)
        out.append(line)
    return out


def in_context(session: Session, cell: str, context: str) -> str | None:
    """The cell treated as a labelled field; None if the label did not come through."""
    head = f"{V.CELL_TITLES.get(context, context)}: "
    done = session.apply(head + cell, "markdown")
    return done[len(head) :] if done.casefold().startswith(head.casefold()) else None


def _lines(rows: Sequence[Sequence[str]]) -> str:
    bars = ["| " + " | ".join(row) + " |" for row in rows]
    return "\n".join([bars[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *bars[1:]])


def _padded(rows: Sequence[Sequence[object]]) -> list[list[object]]:
    width = max(map(len, rows))
    return [[*row, *[""] * (width - len(row))] for row in rows]


def table(rows: Sequence[Sequence[object]], session: Session) -> str:
    """A table of raw cells, each anonymized in its context."""
    if not rows:
        return ""
    rows = _padded(rows)

    def cell(value: object, context: str | None) -> str:
        text = X.escape_cell(value)
        done = in_context(session, text, context) if context and text else None
        return session.apply(text) if done is None else done

    return _lines([[cell(v, c) for v, c in zip(row, line, strict=True)] for row, line in zip(rows, contexts(rows), strict=True)])


def rendered_table(rows: Sequence[Sequence[str]], session: Session) -> str:
    """A table of cells that are anonymized but for what their context tells."""
    if not rows:
        return ""
    # labels are looked up as cells change, left to right
    rows = [list(row) for row in rows]
    heads = [X.cell_kind(cell) for cell in rows[0]]
    look: Callable[[list[str], int], str | None] = lambda row, j: X.cell_kind(row[j - 1]) if j else None
    for i, row in enumerate(rows):
        for j, value in enumerate(row):
            if not value or X.cell_kind(value):
                continue
            context = look(row, j) or (heads[j] if i and j < len(heads) else None)
            done = in_context(session, value, context) if context else None
            row[j] = value if done is None else done
    return _lines([[X.escape_cell(v) for v in row] for row in _padded(rows)])
