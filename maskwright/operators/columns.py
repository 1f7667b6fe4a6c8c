"""Detection and anonymization on DataFrames, through Arrow batches where Python is needed.

Python functions see the text column alone, so filters on other columns still
reach the scan.  Sessions live inside one call: nothing is kept between rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import vocabulary as V
from .detect import detect
from .matching import Rule
from .session import Ner, Session, merge_suggestions
from .structure import delimited, visible

DETECTION = "struct<kind:string,value:string,start:int,end:int,confidence:double,reason:string,placeholder_kind:string,automatic:boolean,source:string>"
EDIT = "struct<start:int,end:int,replacement:string,kind:string,index:int,priority:int>"
SUGGESTION = "struct<kind:string,value:string,target:string,reason:string,confidence:double,source:string>"
EVENT = "struct<absorbed_rule:string,winner:string>"
RESULT = f"text string, edits array<{EDIT}>, matches array<bigint>, absorbed array<bigint>, events array<{EVENT}>, automatic array<struct<kind:string,n:bigint>>, suggestions array<{SUGGESTION}>"


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def detect_spans(include_low_confidence: bool = True, safe_domains: Sequence[str] = V.SAFE_DOMAINS):
    """Column function: all detections of a text column, as an array."""
    domains = tuple(safe_domains)

    @F.pandas_udf(f"array<{DETECTION}>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[d._asdict() for d in detect(_text(t), include_low_confidence, domains)] for t in texts])

    return run


def structural_spans():
    @F.pandas_udf("array<struct<start:int,end:int,content_start:int,content_end:int,opener:string,closer:string,depth:int,balanced:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in delimited(_text(t) or "")] for t in texts])

    return run


def visible_text(markup: str):
    """Column function: the text without its markup."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if _text(t) is None else visible(t, markup).text for t in texts])

    return run


def _summary(session: Session, text: str | None, edits: list, rescan: bool) -> dict:
    suggestions = merge_suggestions(session.suggestions, session.residual(text or "") if rescan else [])
    rules = range(len(session.rules))
    return {
        "text": text,
        "edits": [e._asdict() for e in edits],
        "matches": [session.matches[i] for i in rules],
        "absorbed": [session.absorbed[i] for i in rules],
        "events": [{"absorbed_rule": a, "winner": b} for a, b in session.events],
        "automatic": [{"kind": k, "n": n} for k, n in sorted(session.automatic.items())],
        "suggestions": [s._asdict() for s in suggestions],
    }


def anonymized(rules: Sequence[Rule] = (), markup: str | None = None, rescan: bool = True, ner: Ner | None = None, safe_domains: Sequence[str] = V.SAFE_DOMAINS):
    """Column function: a text column to new text, edits in source places, counts and suggestions.

    Edits are reported for texts without markup.  Null texts stay null.
    """
    domains = tuple(safe_domains)

    @F.pandas_udf(f"struct<{', '.join(p.replace(' ', ':', 1) for p in _fields())}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            session, text, edits = Session(rules, ner, True, domains), _text(value), []
            if text is not None and markup:
                text = session.apply(text, markup)
            elif text is not None:
                text, edits = session.apply_with_edits(text)
            rows.append(_summary(session, text, edits, rescan))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _fields()])

    return run


def edits(rules: Sequence[Rule] = (), ner: Ner | None = None, safe_domains: Sequence[str] = V.SAFE_DOMAINS):
    """Column function: the edits of ``anonymized`` alone, none for null.

    They do not depend on what an output still holds, so it is not searched; rows
    go out as Arrow arrays, without a frame of Python objects between.
    """
    domains = tuple(safe_domains)
    kind = to_arrow_type(DataType.fromDDL(f"array<{EDIT}>"))

    @F.arrow_udf(f"array<{EDIT}>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([Session(rules, ner, True, domains).apply_with_edits(t)[1] if t is not None else [] for t in texts.to_pylist()], kind)

    return run


def _fields() -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(RESULT):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(RESULT[start:i].strip())
            start = i + 1
    return [*out, RESULT[start:].strip()]


def anonymize(docs: DataFrame, rules: Sequence[Rule] = (), text: str = "text", out: str = "result", **options) -> DataFrame:
    """``docs`` with a column ``out`` of new text, edits, counts and suggestions."""
    return docs.withColumn(out, anonymized(rules, **options)(F.col(text)))


def anonymize_units(units: DataFrame, rules: Sequence[Rule] = (), rescan: bool = True, ner: Ner | None = None) -> DataFrame:
    """Documents in units (doc_id, unit_no, markup, text), placeholders numbered through each document in unit order.

    The numbering is sequential by nature, so the units of one document meet in
    one task, in order; documents are dealt evenly, and a task holds one at a
    time.  Result: a row per unit with the new text and, on the first unit, the
    document's counts and suggestions.
    """
    kind = units.schema["doc_id"].dataType.simpleString()
    fields = [f.split(" ")[0] for f in _fields()]

    def document(doc_id, rows: list[tuple]) -> list[tuple]:
        session = Session(rules, ner)
        texts = [None if _text(t) is None else session.apply(t, _text(m)) for _, m, t in rows]
        told = _summary(session, "\n".join(t for t in texts if t is not None), [], rescan)
        return [(doc_id, n, text, *(told[f] if i == 0 else [] for f in fields[1:])) for i, ((n, _, _), text) in enumerate(zip(rows, texts, strict=True))]

    def run(batches):
        held: list[tuple] = []
        of, out = None, []
        for batch in batches:
            for doc_id, *row in zip(batch["doc_id"].tolist(), batch["unit_no"].tolist(), batch["markup"], batch["text"], strict=True):
                if held and doc_id != of:
                    out += document(of, held)
                    held = []
                of = doc_id
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["doc_id", "unit_no", *fields])
            out = []
        if held:
            yield pd.DataFrame(document(of, held), columns=["doc_id", "unit_no", *fields])

    # ids travel as strings, which pandas keeps exact beside nulls
    dealt = units.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("unit_no").cast("int").alias("unit_no"), "markup", "text").repartition("doc_id").sortWithinPartitions("doc_id", "unit_no")
    return dealt.mapInPandas(run, f"doc_id string, unit_no int, {RESULT}").withColumn("doc_id", F.col("doc_id").cast(kind))


def register(spark, rules: Sequence[Rule] = ()) -> None:
    """SQL functions detect_spans(text), anonymize(text), visible_html(text), visible_markdown(text), structural_spans(text)."""
    spark.udf.register("detect_spans", detect_spans())
    spark.udf.register("anonymize", anonymized(rules))
    spark.udf.register("structural_spans", structural_spans())
    for markup in ("html", "markdown"):
        spark.udf.register(f"visible_{markup}", visible_text(markup))
