"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, in their order, with further columns of
any name.  A third of the rows from one source or in one group of copies is no
special case: no stage groups by either.

A row is known by 128 bits of SHA-256 of its id, text, language and source, in
which a null differs from every value: rows that share an id are judged apart, rows
equal in all four are one row repeated.

Odd rows.  Null and empty texts are scored like an empty line by the
classifier; what it keeps of them has no words, so it is no duplicate of
anything but a repeated row, never contaminated, holds no personal data, and is
packed as its end token alone.  Of repeated rows one stays after the second
stage.  Null ids, languages and sources are values like others.  An empty table
gives an empty result.  Very long texts are taken whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.decontaminate import contamination
from maskwright.llm.ngram_join import near_duplicates
from maskwright.llm.packing import pack
from maskwright.llm.pii import replace_entities
from maskwright.llm.quality_crf import keep_good
from maskwright.llm.storage import hashed_side, keep, mark, sweep, write
from maskwright.operators.physical import spread


def _known(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a binary column, of a name not in use, that tells its rows apart."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    # a digest of each value, which no row's null can read like; the text itself is not copied
    told = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in ("doc_id", "text", "lang", "source")]
    return docs.withColumn(row, F.unhex(F.left(F.sha2(F.concat(*told), 256), F.lit(32)))), row


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    known, row = _known(docs)
    found = keep(near_duplicates(known, row).select("doc_id", "group_id"), "groups")
    dropped = keep(found.filter(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias(row)).distinct(), "dropped")
    kept = known.join(hashed_side(dropped), row, "left_anti")
    repeated = keep(found.filter(F.col("doc_id") == F.col("group_id")).groupBy(F.col("doc_id").alias(row)).count().filter("count > 1").select(row), "repeated")
    if repeated.take(1):
        once = kept.join(hashed_side(repeated), row, "left_semi").dropDuplicates([row])
        kept = kept.join(hashed_side(repeated), row, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    known, row = _known(docs)
    found = contamination(known, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    dropped = keep(found.filter("contaminated").select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return known.join(hashed_side(dropped), row, "left_anti").select(docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the new text."""
    return replace_entities(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed."""
    return pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", surrogates),
    ("best-fit packing", packing),
]

#: SQL cannot express these stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written to the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        before = mark()
        out = stage(spark, docs, sf_dir)
        path = write(out, name.replace(" ", "-"))
        sweep(before, path)  # what the stage itself has written
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
