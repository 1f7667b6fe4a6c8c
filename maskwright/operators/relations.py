"""Spans, placeholders, counts, suggestions, gates and tables as relations of built-in operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V


def priority(kind: Column) -> Column:
    out = F.lit(V.OTHER_PRIORITY)
    for k, p in V.PRIORITY.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def document_placeholders(values: DataFrame) -> DataFrame:
    """``values`` (doc_id, ord, kind, value) with the placeholder that each gets when numbered in order within its document.

    Equal values (letters and digits alone) share the placeholder of the first,
    whatever its kind.  Windows are by document.
    """
    keyed = values.withColumn("_key", C.canonical(F.lit("value"), F.col("value")))
    same = Window.partitionBy("doc_id", "_key").orderBy("ord")
    keyed = keyed.withColumns({"_first": F.row_number().over(same) == 1, "_prefix": C.prefix_of(F.first("kind").over(same))})
    by_prefix = Window.partitionBy("doc_id", "_prefix").orderBy("ord")
    keyed = keyed.withColumn("_n", F.sum(F.col("_first").cast("long")).over(by_prefix.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.first(F.when(F.col("_first"), F.col("_n")), ignorenulls=True).over(Window.partitionBy("doc_id", "_key"))
    return keyed.withColumn("placeholder", C.placeholder(F.col("_prefix"), number)).drop("_key", "_first", "_prefix", "_n")


def corpus_placeholders(values: DataFrame, key: str, digits: int = 16) -> DataFrame:
    """``values`` (kind, value) with placeholders that hold through the whole corpus: a keyed digest instead of a number, so nothing is sorted."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), C.canonical(F.lit("value"), F.col("value"))), 256)
    return values.withColumn("placeholder", F.concat(C.prefix_of(F.col("kind")), F.lit("-"), F.substring(digest, 1, digits)))


def _reach(spans: DataFrame, by: DataFrame, at: Column, first: int) -> tuple[DataFrame, Column]:
    """``spans`` with ``_reach``: how far the spans of ``by`` go that start before ``at`` (or, with ``first`` 0, at it) in the same document.

    One sweep over each document's places, whatever the number of spans.
    """
    rows = spans.withColumns({"_at": at.cast("long"), "_by": F.lit(1 - first), "_to": F.lit(None).cast("long")})
    marks = by.select("doc_id", F.col("start").cast("long").alias("_at"), F.lit(first).alias("_by"), F.col("end").cast("long").alias("_to"), F.lit(True).alias("_mark"))
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("doc_id").orderBy("_at", "_by").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_reach", F.when(F.col("doc_id").isNotNull(), F.max("_to").over(sweep))).filter(~F.col("_mark"))
    return swept.select(*spans.columns, "_reach"), F.col("_reach")


def not_overlapped(spans: DataFrame, by: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) that no span of ``by`` overlaps; a null document is no document."""
    # the spans that start before the end: does one of them go beyond the start?
    swept, reach = _reach(spans, by, F.col("end"), 1)
    return swept.filter(reach.isNull() | (reach <= F.col("start"))).drop("_reach")


def not_contained(spans: DataFrame, by: DataFrame) -> DataFrame:
    """Spans that no span of ``by`` contains."""
    swept, reach = _reach(spans, by, F.col("start"), 0)
    return swept.filter(reach.isNull() | (reach < F.col("end"))).drop("_reach")


def unprotected(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Values (kind, value) that are neither safe nor equal to a rule's target (target)."""
    known = targets.filter("target <> ''").select(C.canonical(F.lit("value"), F.col("target")).alias("_t")).distinct()
    return values.filter(~C.is_safe(F.col("kind"), F.col("value"))).join(known, C.canonical(F.lit("value"), F.col("value")) == F.col("_t"), "left_anti")


def rule_counts(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Per rule (rule_idx): matches, absorbed and effective counts of ``edits`` (index, selected), zeros kept."""
    n = edits.groupBy(F.col("index").alias("rule_idx")).agg(F.sum(F.col("selected").cast("long")).alias("matches"), F.sum((~F.col("selected")).cast("long")).alias("absorbed"))
    out = rules.join(n, "rule_idx", "left").na.fill(0, ["matches", "absorbed"])
    return out.withColumn("effective", F.col("matches") + F.col("absorbed"))


def top_suggestions(found: DataFrame, most: int = V.MOST_SUGGESTIONS) -> DataFrame:
    """``found`` (doc_id, ord, kind, value): the first of each (kind, value), at most ``most`` a document."""
    key = C.canonical(F.col("kind"), F.col("value"))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "kind", key).orderBy("ord"))).filter("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "kind", "value"))).filter(F.col("rank") <= most).drop("_n")


def automatic_report(edits: DataFrame) -> DataFrame:
    """Per kind: number of replacements and the form of its placeholder."""
    out = edits.groupBy("kind").agg(F.count(F.lit(1)).alias("matches"))
    return out.select("kind", "matches", C.placeholder(C.prefix_of(F.col("kind")), F.lit(1)).alias("replacement"), F.lit("replaced").alias("status"))


def gate(documents: DataFrame, require_all_rules: bool = False, strict: bool = False, allow_zero: bool = False) -> DataFrame:
    """``documents`` (matches, absorbed: arrays by rule; n_automatic; n_suggestions) with problems and status.

    Fail closed: a document with any problem is 'refused' and must not be written.
    """
    total = F.aggregate("matches", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("n_automatic")
    missing = F.filter(F.transform("matches", lambda m, i: F.when(m + F.col("absorbed")[i] == 0, F.concat(F.lit("rule-"), F.lpad((i + 1).cast("string"), 3, "0")))), lambda x: x.isNotNull())
    problems = [
        F.when((total == 0) & F.lit(not allow_zero), "zero replacements/redactions matched"),
        F.when((F.size(missing) > 0) & F.lit(require_all_rules), F.concat(F.lit("rules with zero matches: "), F.array_join(F.slice(missing, 1, V.NAMED_RULES), ", "))),
        F.when((F.col("n_suggestions") > 0) & F.lit(strict), F.concat(F.col("n_suggestions").cast("string"), F.lit(" possible sensitive values still present"))),
    ]
    out = documents.withColumn("problems", F.array_compact(F.array(*problems)))
    return out.withColumn("status", F.when(F.size("problems") == 0, "passed").otherwise("refused"))


def cell_contexts(cells: DataFrame) -> DataFrame:
    """``cells`` (doc_id, row_idx, col_idx, value) with ``context``: the kind their left neighbour or header announces.

    Labels have no context of their own; headers count for the rows below.
    """
    kind = C.cell_kind(F.col("value"))
    left = F.lag(kind).over(Window.partitionBy("doc_id", "row_idx").orderBy("col_idx"))
    head = F.first(F.when(F.col("row_idx") == 0, kind)).over(Window.partitionBy("doc_id", "col_idx").orderBy("row_idx"))
    return cells.withColumn("context", F.when(kind.isNull(), F.coalesce(left, F.when(F.col("row_idx") > 0, head))))


def trim_edges(cells: DataFrame) -> DataFrame:
    """Without the empty rows and columns at the end of each table; leading ones stay."""
    ends = cells.filter("value <> ''").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("row_idx").alias("_row"), F.max("col_idx").alias("_col"))
    return cells.join(ends, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_idx") <= F.col("_row")) & (F.col("col_idx") <= F.col("_col"))).select(*cells.columns)


def markdown_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, markdown) of complete tables: the first row is the header."""
    rows = cells.groupBy("doc_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", C.escape_cell(F.col("value")).alias("v")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.col("c.v"), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.size("c")), " | "), F.lit(" |"))
    rows = rows.select("doc_id", "row_idx", F.concat(line, F.when(F.col("row_idx") == 0, rule).otherwise("")).alias("line"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("l")).select("doc_id", F.array_join(F.col("l.line"), "\n").alias("markdown"))


def confident_boxes(boxes: DataFrame, least: float = 45.0) -> DataFrame:
    """Recognised words, without blanks and without known confidences below ``least``."""
    return boxes.filter((F.trim("text") != "") & ~((F.col("confidence") >= 0) & (F.col("confidence") < least)))


def padded_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box three wider and two higher on each side, inside the image, in whole pixels."""
    cut = lambda c: c.cast("int")
    return F.struct(
        cut(F.greatest(F.lit(0), left - 3)).alias("left"), cut(F.greatest(F.lit(0), top - 2)).alias("top"), cut(F.least(width, right + 3)).alias("right"), cut(F.least(height, bottom + 2)).alias("bottom")
    )


def header_height(height: Column, share: Column) -> Column:
    """Pixels of a redacted header: a share of the height up to 1, else pixels."""
    return F.greatest(F.lit(1), F.least(height, F.when(share <= 1, (height * share).cast("int")).otherwise(share.cast("int"))))
