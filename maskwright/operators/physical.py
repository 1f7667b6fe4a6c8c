"""Physical choices that results do not depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is too small for its files to occupy them.

    A small file may be a single row group, which one task reads whole.  Tables
    with a full split for every core are left as they are: dealing them would
    only add a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * split else df
