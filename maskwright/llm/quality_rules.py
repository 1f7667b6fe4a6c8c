"""Quality rules: a learned decision list over text statistics, in built-in functions only.

``statistics`` counts words, symbols, repeated lines and repeated three-word
windows (by 64-bit hashes) of whole texts.  ``learn`` covers a labelled sample
one rule after the other.  For either class a rule grows, threshold by
threshold, on two thirds of what is left by information gain, and is pruned on
the last third.  A rule that rejects must be right for ``PRECISION`` of what it
holds for among what is left, one that keeps for ``KEEP_PRECISION``; of the two the one that covers
more of its class is next in the list, so the order decides wherever a
keeping rule stands before a rejecting one.  Documents that no rule holds for
are kept.  A list has at most ``MOST_RULES`` rules of at most
``MOST_CONDITIONS`` conditions; these bound the model, not the data it is for.
``verdict`` writes the list as one ordered CASE expression.  The sample is at most ``max_docs`` labelled documents
by hash order of their ids, one row for each id; only their statistics reach the driver.

Null and empty texts have no words and fail the base rules; so do texts of
fewer than 50 words, or with more than half of the words in repeated windows.
Without labels of both classes the list is empty.  Repeated rows give repeated
results; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import settled

SYMBOLS = "#*$%&|<>"
MAX_DOCS = 4000
PRECISION, KEEP_PRECISION = 0.9, 0.995
MOST_RULES, MOST_CONDITIONS = 12, 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
#: Inputs of the rules: whole numbers, shares in thousandths, so every engine agrees.
MEASURES = {
    "words": "n_words",
    "width": "10 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "bangs": "1000 * n_bangs div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}
Rule = list[tuple[str, str, int]]


def _removed(column: str, characters: str) -> Column:
    return (F.length(column) - F.length(F.translate(column, characters, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document's whole text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumn("w", F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"))
    df = df.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _removed("t", SYMBOLS).alias("n_symbols"), _removed("t", UPPER).alias("n_upper"), _removed("t", "!").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "w",
    )
    # windows by hash, then place: equal ones stand side by side
    df = df.withColumn("v", F.expr("sort_array(if(n_words > 2, transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)), array()))"))
    df = df.withColumn("r", F.expr("sort_array(transform(filter(v, (x, k) -> x.h <=> get(v, k - 1).h or x.h <=> get(v, k + 1).h), x -> x.i))"))
    covered = "aggregate(r, struct(0L as c, 0 as e), (a, i) -> struct(a.c + i + 3 - greatest(a.e, i) as c, i + 3 as e), a -> a.c)"
    df = df.withColumn("n_repeat_words", F.expr(covered)).drop("w", "v", "r")
    return settled(df, ["doc_id"], [c for c in df.columns if c != "doc_id"])


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _information(p: int, n: int) -> float:
    return math.log2(p / (p + n)) if p else -math.inf


def _covers(rule: Rule, row: dict[str, int]) -> bool:
    return all(row[m] >= v if op == ">=" else row[m] <= v for m, op, v in rule)


def _grow(rows: list[tuple[dict[str, int], int]], most: int) -> Rule:
    rule: Rule = []
    while len(rule) < most:
        p = sum(bad for _, bad in rows)
        n = len(rows) - p
        if not p or not n:
            break
        best, gain = None, 1e-9
        for m in MEASURES:
            ordered = sorted((row[m], bad) for row, bad in rows)
            for op, sequence in ((">=", ordered[::-1]), ("<=", ordered)):
                tp = tn = 0
                for i, (v, bad) in enumerate(sequence):
                    tp += bad
                    tn += 1 - bad
                    if i + 1 < len(sequence) and sequence[i + 1][0] == v:
                        continue
                    # between the last value taken and the next
                    if tp and (g := tp * (_information(tp, tn) - _information(p, n))) > gain:
                        after = sequence[i + 1][0] if i + 1 < len(sequence) else v
                        cut = (v + after + 1) // 2 if op == ">=" else (v + after) // 2
                        best, gain = (m, op, cut), g
        if best is None or best in rule:
            break
        rule.append(best)
        rows = [(row, bad) for row, bad in rows if _covers([best], row)]
    return rule


def _worth(rule: Rule, rows: list[tuple[dict[str, int], int]]) -> float:
    caught = [wanted for row, wanted in rows if _covers(rule, row)]
    return (2 * sum(caught) - len(caught)) / len(caught) if caught else -1.0


def _rule(rows: list[tuple[dict[str, int], int]], most: int) -> Rule:
    """A rule for the rows marked 1, grown on two thirds and pruned on one."""
    rule = _grow([r for i, r in enumerate(rows) if i % 3 != 2], most)
    pruning = [r for i, r in enumerate(rows) if i % 3 == 2]
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, pruning), default=[])


def learn(rows: list[tuple[dict[str, int], int]], precision: float = PRECISION, keep_precision: float = KEEP_PRECISION, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[tuple[Rule, bool]]:
    """The ordered list of (rule, whether it keeps), from (measures, 1 if bad) rows in a fixed order."""
    rules: list[tuple[Rule, bool]] = []
    left = list(rows)
    while any(bad for _, bad in left) and len(rules) < most_rules:
        best, share = None, 0.0
        for keeps in (False, True):
            marked = [(row, bad ^ keeps) for row, bad in left]
            rule = _rule(marked, most_conditions)
            caught = [wanted for row, wanted in marked if _covers(rule, row)]
            if not rule or not sum(caught) or sum(caught) < (keep_precision if keeps else precision) * len(caught):
                continue
            covered = sum(caught) / sum(wanted for _, wanted in marked)
            if covered > share:
                best, share = (rule, keeps), covered
        if best is None:
            break
        rules.append(best)
        left = [(row, bad) for row, bad in left if not _covers(best[0], row)]
    while rules and rules[-1][1]:
        rules.pop()  # documents without a rule are kept anyway
    return rules


def verdict(rules: list[tuple[Rule, bool]]) -> str:
    """The list as SQL: the first rule that holds decides."""
    if not rules:
        return "true"
    cases = " ".join("WHEN " + " AND ".join(f"({MEASURES[m]}) {op} {v}" for m, op, v in rule) + f" THEN {str(keeps).lower()}" for rule, keeps in rules)
    return f"CASE {cases} ELSE true END"


def decide(rules: list[tuple[Rule, bool]], row: dict[str, int]) -> bool:
    """The verdict on one document's measures, without a session."""
    return next((keeps for rule, keeps in rules if _covers(rule, row)), True)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> list[tuple[Rule, bool]]:
    """The list learned from at most ``max_docs`` labelled documents that pass the base rules."""
    sample = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # of rows that share an id one stands for all, by hash of the text
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row")).select("doc_id", "row.text")
    stats = statistics(chosen).join(F.broadcast(sample), "doc_id").filter(~base_failed())
    found = stats.select("doc_id", "quality", *(F.expr(e).alias(m) for m, e in MEASURES.items())).collect()
    found.sort(key=lambda r: tuple(r))
    return learn([({m: r[m] for m in MEASURES}, 1 - r.quality) for r in found])


def quality_report(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    rules = train(docs, labels, max_docs)
    out = statistics(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.expr(verdict(rules))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
