"""What the operators of this folder share: tables, the shared scratch folder, running totals."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

__all__ = ["TEXT_ROWS", "give_back", "in_few_files", "in_files", "keep_memory", "running_starts", "sampled", "scratch", "stored", "table", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts in one Arrow batch; batches lie outside of the heap, twice for each task.
TEXT_ROWS = 2000
#: Bytes after which an Arrow batch ends, whatever its rows; a single longer row is a batch by itself.
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new shared folder (see ``session.scratch``). From here on the session's Arrow batches are bounded by bytes too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "64m").rstrip("bkmg") or 0) != BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return session.scratch(spark)


def stored(df: DataFrame, path: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in a shared folder and read it again: lineage ends here, and a lost executor costs nothing.

    ``batch_rows`` holds for the Python operators of this one write.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by a hash of ``keys``; all of them if there are no more. Rows with equal keys stay together."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < (most << 40) // n)


def in_files(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """``df``, of at most ``rows`` short rows, in as few partitions as hold ``each`` rows: no table of many tiny files."""
    return df.coalesce(max(1, -(-rows // each)))


def in_few_files(df: DataFrame, n: int, each: int = 50_000) -> DataFrame:
    """``df`` dealt out to a partition for every ``each`` of ``n`` inputs, for rows that many tasks find a few of.

    Unlike ``in_files`` this shuffles, so the tasks that find the rows stay as many. On a local disk
    the JVM starts processes for each file that it writes, and just then these seem as large as itself.
    """
    return df.repartition(max(1, -(-n // each)))


def give_back() -> None:
    """Free memory goes back to the system: Arrow's pool, and what the C library keeps, if it can be asked."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def keep_memory() -> None:
    """From here on the C library keeps up to 64 MB that this process frees, if it can be asked: pages that go back to the system each time have to be cleared each time. ``give_back`` still returns them."""
    try:
        for what, size in ((-1, 64 << 20), (-3, 32 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(what, size)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory back when its task ends: a Python worker lives on, beside the tasks of later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def running_starts(df: DataFrame, order: list[str], size: str, path: str, start: str = "start") -> DataFrame:
    """Add ``start``, the sum of ``size`` over all rows before this one in ``order``.

    Rows are range-sorted, summed within each task, and stored; only one total per task goes to the
    driver, so the size of what is collected is the number of partitions. ``order`` must tell all
    rows apart, or rows that tie come in any order. Adds ``part``, the task that held the row.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.LongType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = b[size].astype("int64").cumsum() + total
            b["part"], b["_local"] = part, ends - b[size].astype("int64")
            total = int(ends.iloc[-1]) if len(b) else total
            yield b

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(local, schema), path)
    base, bases = 0, []
    for r in sorted(rows.groupBy("part").agg(F.sum(size).alias("total")).collect()):
        bases.append((r["part"], base))
        base += r["total"] or 0
    at = spark.createDataFrame(bases, "part long, _base long")  # one row for each partition
    return rows.join(F.broadcast(at), "part").withColumn(start, F.col("_local") + F.col("_base")).drop("_local", "_base")
