"""Chat formatting of maximal conversations, after cumulative-snapshot collapse.

A conversation that was logged again and again while it grew appears as many
ids, each the beginning of the next.  Every turn gets the rolling hash of all
turns up to it; a conversation whose last hash is also the hash of another one
before its end is a prefix of it and goes, by an anti-join.  Of equal
conversations the smallest id stays.  What remains is rendered.

A rolling hash is a sum of two 64-bit hashes of place, role and text, so it is
built from sums over blocks of turns and needs no conversation in one piece;
rendered conversations come as one row per ``block`` of ``BLOCK`` places.  Where
a block holds more than ``BLOCK`` different turns, as many without a number or
of one place do, it comes in several rows, ``part`` by part, a turn's part being
a hash of it.  Hashes of turns that many conversations share are reduced before
any shuffle.

Markers inside of roles and texts are escaped: every ``<``, backslashes and
``|`` gets one more backslash, so a rendered text can be read back exactly.

The place of a turn is its number less the conversation's first; turns without
a number come before.  Turns of one place are ordered by role and text, and
rows that repeat a turn count once.  Null roles and texts are taken as ''.
Rows without a conversation id are one conversation.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

BLOCK = 1024
#: Fixed template of a rendered turn.
OPEN, END = "<|{}|>\n", "<|end|>\n"


def places(conversations: DataFrame) -> DataFrame:
    """Distinct turns as conv_id, place, block, role, text."""
    first = conversations.groupBy("conv_id").agg(F.min("turn").alias("first")).select(F.col("conv_id").alias("of"), "first")
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("place", F.coalesce(F.col("turn") - F.col("first"), F.lit(-1)).cast("long"))
    return turns.select("conv_id", "place", F.floor(F.col("place") / BLOCK).alias("block"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, hash of all turns up to it (h1, h2), and whether it is the last place."""
    hashed = turns.select("conv_id", "block", "place", *(F.xxhash64(F.lit(seed), "place", "role", "text").alias(f"t{i}") for i, seed in ((1, 71), (2, 1009)))).distinct()
    sums = [F.sum(F.col(f"t{i}").cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)]
    steps = keep(hashed.groupBy("conv_id", "block", "place").agg(*sums), "chat-steps")
    blocks = steps.groupBy("conv_id", "block").agg(*(F.sum(f"s{i}").cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)), F.max("place").alias("end"))
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("of"), F.col("block").alias("in"), *(F.coalesce(F.sum(f"b{i}").over(whole), F.lit(0)).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)), F.max("end").over(Window.partitionBy("conv_id")).alias("end")
    )
    own = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inner = steps.select("conv_id", "block", "place", *(F.sum(f"s{i}").over(own).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)))
    joined = inner.join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return joined.select("conv_id", "place", *((F.col(f"s{i}") + F.col(f"b{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)), (F.col("place") == F.col("end")).alias("last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_copies of the conversations that no other one continues."""
    found = keep(prefixes(places(conversations)), "chat-prefixes")
    inner = found.filter(~F.col("last")).groupBy("place", "h1", "h2").agg(F.lit(1).alias("one"))
    whole = found.filter("last").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def _parts(turns: DataFrame) -> DataFrame:
    """``turns`` with the number of parts of their block, by its different turns."""
    many = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BLOCK).select(F.col("conv_id").alias("of"), F.col("block").alias("in"))
    here = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))
    many = keep(many, "chat-long-blocks")
    distinct = turns.select("conv_id", "block", "place", "role", "text").join(many, here, "left_semi").distinct()
    sizes = distinct.groupBy("conv_id", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("of"), F.col("block").alias("in"), "parts")
    return turns.join(keep(sizes, "chat-parts"), here, "left").drop("of", "in").withColumn("part", F.pmod(F.xxhash64("place", "role", "text"), F.coalesce("parts", F.lit(1))).cast("long")).drop("parts")


def escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"<(\\*)\|", r"<\\$1|")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, block, part, n_turns, n_copies and the rendered text of every maximal conversation."""
    kept = keep(maximal(conversations).withColumnRenamed("conv_id", "of"), "chat-maximal")
    turns = places(conversations).join(kept, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    blocks = _parts(turns).groupBy("conv_id", "block", "part").agg(F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_set(F.struct("place", "role", "text"))).alias("turns"))
    head, _, tail = OPEN.partition("{}")
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(head), escaped(t["role"]), F.lit(tail), escaped(t["text"]), F.lit(END))), "")
    return blocks.select("conv_id", "block", "part", F.size("turns").cast("long").alias("n_turns"), "n_copies", text.alias("text"))
