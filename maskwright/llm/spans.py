"""Offsets of regular-expression matches, with built-in functions only.

Matches are marked by a character that no pattern can match, the text is split
at the marks, and the parts' lengths are summed up to code-point offsets.  Sums
go by blocks, so a text with very many matches costs little more than a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
_BLOCK = 256


def literal(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_spans(df: DataFrame, text: str, pattern: str, out: str, condition: str = "true") -> DataFrame:
    """Adds ``out``, an array of (s, e, m) for all leftmost non-overlapping matches.

    ``text`` must be a column without nulls and without MARK; ``condition`` is
    SQL on ``p``, the matched text.  Matches must not be empty.
    """
    parts, lens, blocks, firsts, starts = (f"{out}_{i}" for i in ("parts", "lens", "blocks", "firsts", "starts"))
    return (
        df.withColumn(parts, F.split(F.regexp_replace(F.col(text), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1))
        .withColumn(lens, F.expr(f"transform({parts}, p -> cast(length(p) as bigint))"))
        .withColumn(blocks, F.expr(f"transform(sequence(0, (size({lens}) - 1) div {_BLOCK}), k -> slice({lens}, cast(k as int) * {_BLOCK} + 1, {_BLOCK}))"))
        .withColumn(firsts, F.expr(f"slice(aggregate({blocks}, array(0L), (a, b) -> concat(a, array(element_at(a, -1) + aggregate(b, 0L, (x, y) -> x + y)))), 1, size({blocks}))"))
        .withColumn(starts, F.expr(f"flatten(zip_with({blocks}, {firsts}, (b, s) -> slice(aggregate(b, array(s), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size(b))))"))
        .withColumn(out, F.expr(f"filter(transform({parts}, (p, i) -> if(i % 2 = 1 and {condition}, struct({starts}[i] as s, {starts}[i] + length(p) as e, p as m), null)), x -> x is not null)"))
        .drop(parts, lens, blocks, firsts, starts)
    )


def settled(df: DataFrame, keep: list[str], computed: list[str]) -> DataFrame:
    """``df`` with ``computed`` behind a generator, past which no filter is pushed.

    A filter pushed below would put the expressions of arrays into the bodies
    of functions that run for each of their elements.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))
