"""Small helpers that the operators share: scratch tables, file access, id ranges, worker memory."""

from __future__ import annotations

import ctypes
import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir.

    Only a local master may go without that setting; a local temporary folder is then made
    once and set as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chatloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder URI; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


#: Bytes of an Arrow batch.
BATCH = "2m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: What modules keep in a Python worker during a task, as functions that clear it.
_kept: list[Callable[[], None]] = []


def clear_after_task(clear: Callable[[], None]) -> None:
    _kept.append(clear)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a mapInArrow function, giving its worker's memory back when the task ends.

    Workers live on from task to task and from stage to stage, so what one task has learned must
    not stay beside what the next one needs. Freed pages go back to the system. The session's Arrow
    batches are set to BATCH unless they have another size than Spark's own: every task holds a
    batch several times over, on both sides of the pipe and outside the JVM's heap.
    """
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for clear in _kept:
                clear()
            give_back()

    return tidied


def give_back() -> None:
    """Return Arrow's and the C library's unused pages to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null stays null."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys sampled for each range.
SAMPLE = 64


def range_bounds(keys: DataFrame, width: int) -> list[tuple]:
    """At most width - 1 keys (of two longs) that cut the rows of keys into even ranges, in order, nulls first.

    The bounds depend on the rows and the width alone: the sample is of keys whose hash is divisible by a number
    that the row count sets, so it has some SAMPLE x width different keys, with their exact counts.
    """
    a, b = keys.columns
    every = max(1, keys.count() // (SAMPLE * width))
    sample = keys.where(F.pmod(F.xxhash64(a, b), F.lit(every)) == 0).groupBy(a, b).agg(F.count("*").alias("n")).collect()
    sample.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    total, seen, bounds = sum(r.n for r in sample), 0, []
    for r in sample:
        # a range begins with the first key that has its share of rows before it
        if seen and len(bounds) + 1 < width and seen * width >= (len(bounds) + 1) * total:
            bounds.append((r[0], r[1]))
        seen += r.n
    return bounds


def range_sorted(df: DataFrame, keys: DataFrame, rest: list[str]) -> DataFrame:
    """df in range partitions by the key columns (two longs), nulls first, sorted by the key and then the rest.

    keys has the same key columns for about the same rows, without what is costly to make. With a hash of
    the content as the key's second column, rows that share an id (or have none) are spread. A partition is sorted
    with spilling, and has the same rows on every run.
    """
    width = shuffle_width(df.sparkSession)
    bounds = range_bounds(keys, width)
    a, b = keys.columns
    own = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    listed = F.from_json(F.lit(json.dumps([{"a": x, "b": y} for x, y in bounds])), "array<struct<a:bigint,b:bigint>>")
    # which range: first among every step-th bound, then between two of them
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.from_json(F.lit(json.dumps([{"a": x, "b": y} for x, y in bounds[step - 1 :: step]])), "array<struct<a:bigint,b:bigint>>")
    below = lambda some: F.size(F.filter(some, lambda x: x <= own))
    rows = df.withColumn("range__c", below(coarse) * step)
    rows = rows.withColumn("range__c", F.col("range__c") + below(F.slice(listed, F.col("range__c") + 1, F.lit(step))))
    order = [F.col(c).asc_nulls_first() for c in (a, b)]
    return rows.repartitionById(width, F.col("range__c")).sortWithinPartitions(*order, *rest).drop("range__c")
