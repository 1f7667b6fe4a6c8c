"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where it is unset
and all tasks run in the driver's process, as in local tests, a temporary one
is made and set; on a cluster an unset one is an error.  A written table cuts the
lineage: a lost executor costs the tasks it ran, never the stages before.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="maskwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Limits the session's Arrow batches, which bound what a Python worker holds, to ``limit`` bytes.

    The setting stays, as plans run after the call that makes them; smaller ones are left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)([kmg]?)", spark.conf.get(name, "1g").lower())
    if not now or int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] > limit:
        spark.conf.set(name, str(limit))


def released(run: Callable) -> Callable:
    """``run`` over Arrow batches, which at its end gives freed memory back, as the worker may stay for other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Rows of some tables are megabytes: groups of this size bound what their writers and readers hold.
ROW_GROUP = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1000}


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet in the shared folder; its path, removed by ``sweep`` or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    df.write.options(**ROW_GROUP).parquet(path)
    _written.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it again."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def hashed_side(ids: DataFrame, row_bytes: int = 64, most: int = 32 << 20) -> DataFrame:
    """``ids``, a written table, marked as the hashed side of a join where its counted size allows it.

    Texts then stream past it and are not sorted.  Up to ``most`` bytes it is
    broadcast; up to ``most`` bytes a partition each task hashes its own share;
    beyond that the choice is Spark's.
    """
    size = ids.count() * row_bytes
    if size <= most:
        return ids.hint("broadcast")
    partitions = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.hint("shuffle_hash") if size <= most * partitions else ids


def mark() -> int:
    """A place in the list of written tables, for ``sweep``."""
    return len(_written)


@atexit.register
def sweep(since: int = 0, but: str | None = None) -> None:
    """Removes the tables written after ``since``, when nothing that reads them is left to run."""
    for at in range(len(_written) - 1, since - 1, -1):
        spark, path = _written[at]
        if path == but:
            continue
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
        del _written[at]
