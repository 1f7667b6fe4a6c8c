"""Anonymization of streams: the column functions run unchanged, numbering is by event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import anonymized
from ..operators.matching import Rule


def anonymize_stream(events: DataFrame, text: str = "text", rules: Sequence[Rule] = ()) -> DataFrame:
    """A streaming DataFrame with its text column replaced and ``n_automatic`` added."""
    out = events.withColumn("_r", anonymized(rules, rescan=False)(F.col(text)))
    n = F.coalesce(F.aggregate("_r.automatic", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    return out.withColumns({text: F.col("_r.text"), "n_automatic": n}).drop("_r")


def counts_by_window(events: DataFrame, time: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Replacements per window of event time, for streams of ``anonymize_stream``."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"))
    return windows.agg(F.sum("n_automatic").alias("n_automatic"), F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "n_automatic", "n_events")
